"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become words: runs of letters and digits, where a number such as ``1,250``
or ``3.5`` is one word.  There are three forms of them:

* ``TYPED``: numbers, units and names (runs of capitalised words, one slot each)
  are placeholders of their type, other words are in lower case;
* ``PLAIN``: the same with names as words in lower case, so that copies in
  capitals or without them are found;
* ``VERBATIM``: every word in lower case, without placeholders.

Every window of ``WINDOW`` words of an item is hashed in its forms (an item of
fewer words is one window), and every window of a document, at every word; both
sides are hash-joined.  A template window needs ``LITERAL`` words outside slots
to stand for its item: an item that offers too few of them is looked up in the
verbatim form, and then has to be copied word for word.

1. A search of all documents keeps the keys of those that share enough windows
   with the benchmark.  It carries hashes alone.
2. In these documents, windows at one shift of one item are put together.  Their
   slots have to be consistent: each value of the item stands for one value of
   the document, and the other way round (a name at an item's edge is left out,
   since the document's run of names may go on).  At least half of the windows
   that the item offers in that form, two at least, have to match; all of them
   for items of fewer than ``SHORTEST`` words and in the verbatim form.  Names as
   words do not count where the typed form matches a larger share of its windows
   and its slots are not consistent: another name stands at one of its places.

The item windows and the keys of the first step are broadcast only if they are
at most ``BROADCAST`` rows (counted first); beyond that the join is a plain hash
or merge join.

Defined cases: null and empty texts and items match nothing; repeated items
count as items of their own; documents that are copies have rows each; a null
item identifier is an identifier like any other; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import KEY, checkpoint, keyed, with_row

WINDOW = 4
LITERAL = 2
SHORTEST = 8
BROADCAST = 200_000
NUMBER, NAME, UNIT = "#", "@", "&"
TYPED, PLAIN, VERBATIM = range(3)
# Units of measure, money and time.
UNITS = "km kg cm mm mg lb lbs oz ft mph kmh hz khz mhz ghz kb mb gb tb kwh percent dollar dollars euro euros pound pounds cent cents mile miles meter meters metre metres kilometer kilometers kilometre kilometres kilogram kilograms gram grams liter liters litre litres hour hours minute minutes second seconds day days week weeks month months year years degree degrees".split()
#: What stands between words: all but letters, digits and the points and commas between two digits.
BETWEEN = r"(?:[^\p{L}\p{N}.,]|[.,](?!\p{N})|(?<!\p{N})[.,])+"


def _first(word: Column, plain: tuple[str, str], kind: str) -> Column:
    """Whether a word's first character is of a kind; ASCII is told by comparison, the rest by a pattern."""
    return ((word >= plain[0]) & (word <= plain[1] + "\U0010ffff")) | ((word >= "\u0080") & word.rlike(rf"^\p{{{kind}}}"))


def _typed(word: Column) -> Column:
    low = F.lower(word)
    return F.when(_first(word, ("0", "9"), "N"), NUMBER).when(_first(word, ("A", "Z"), "Lu"), NAME).when(low.isin(UNITS), UNIT).otherwise(low)


def forms(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the words of a text in the three forms, and the first word of each token of the typed one."""
    plain_numbers = ~F.col(text).rlike(r"\p{N}[.,]\p{N}")  # then the simple pattern does the same
    out = df.withColumn("words", F.filter(F.when(plain_numbers, F.split(text, r"[^\p{L}\p{N}]+")).otherwise(F.split(text, BETWEEN)), lambda w: w != ""))
    out = out.withColumn("each", F.transform("words", _typed)).withColumn("plain", F.zip_with("words", "each", lambda w, e: F.when(e == NAME, F.when(F.lower(w).isin(UNITS), UNIT).otherwise(F.lower(w))).otherwise(e)))
    head = lambda x, i: (x != NAME) | (i == 0) | (F.get("each", F.greatest(i - 1, F.lit(0))) != NAME)
    return out.withColumn("typed", F.filter("each", head))


def _starts(tokens: Column, size: int) -> Column:
    return F.when(F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size)).otherwise(F.array().cast("array<int>"))


def _literal(tokens: Column) -> Column:
    """How many words of a template are no slots."""
    return F.size(F.filter(tokens, lambda x: ~x.isin(NUMBER, NAME, UNIT)))


def _with_values(df: DataFrame) -> DataFrame:
    """Rows of one form each: ``form``, its ``tokens`` and what stands for each of them (``values``)."""
    low = df.withColumn("verbatim", F.transform("words", lambda w: F.lower(F.regexp_replace(w, ",", ""))))
    head = F.filter(F.sequence(F.lit(0), F.size("each")), lambda i: (i == F.size("each")) | (F.coalesce(F.get("each", i), F.lit("")) != NAME) | (i == 0) | (F.coalesce(F.get("each", i - 1), F.lit("")) != NAME))
    low = low.withColumn("head", head)
    runs = F.transform("typed", lambda _, j: F.array_join(F.slice("verbatim", F.get("head", j) + 1, F.get("head", j + 1) - F.get("head", j)), "_"))
    rows = F.array(*[F.struct(F.lit(form).alias("form"), F.col(tokens).alias("tokens"), values.alias("values")) for form, tokens, values in ((TYPED, "typed", runs), (PLAIN, "plain", F.col("verbatim")), (VERBATIM, "verbatim", F.col("verbatim")))])
    kept = [c for c in df.columns if c not in ("words", "each", "plain", "typed")]
    return low.select(*kept, F.explode(rows).alias("f")).where(F.size("f.tokens") > 0).select(*kept, "f.*")


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, copy, form, size (words of a window), at, w, tokens and values of the window, ``last`` start, and how many windows are needed, for all windows of items that count."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("item"))
    items = _with_values(forms(items.withColumn("copy", F.xxhash64("item")), "item").drop("item")).distinct()
    size = F.least(F.size("tokens"), F.lit(WINDOW))
    cut = F.transform(F.sequence(F.lit(0), F.size("tokens") - size), lambda i: F.struct(i.alias("at"), F.slice("tokens", i + 1, size).alias("tokens"), F.slice("values", i + 1, size).alias("values")))
    usable = F.filter(cut, lambda c: (F.col("form") == VERBATIM) | (_literal(c["tokens"]) >= LITERAL))
    items = items.select("item_id", "copy", "form", size.alias("size"), (F.size("tokens") - size).alias("last"), F.size("tokens").alias("n"), usable.alias("usable")).withColumn("offered", F.size("usable"))
    enough = F.col("offered") >= F.when(F.col("n") >= SHORTEST, 2).otherwise(1)
    strong = items.where((F.col("form") == TYPED) & enough).select("item_id", "copy", F.lit(True).alias("strong")).distinct()
    same = F.col("i.item_id").eqNullSafe(F.col("s.item_id")) & (F.col("i.copy") == F.col("s.copy"))
    items = items.alias("i").join(strong.alias("s"), same, "left").where((F.col("form") == VERBATIM) & F.col("strong").isNull() | (F.col("form") != VERBATIM) & enough).select("i.*")
    need = F.when((F.col("n") < SHORTEST) | (F.col("form") == VERBATIM), F.col("offered")).otherwise(F.greatest(F.lit(2), F.floor(F.col("offered") / 2))).cast("int")
    return items.select("item_id", "copy", "form", "size", "last", "offered", need.alias("need"), F.explode("usable").alias("u")).select("item_id", "copy", "form", "size", "last", "offered", "need", F.col("u.at").alias("item_at"), F.col("u.tokens").alias("kind"), F.col("u.values").alias("theirs")).withColumn("w", _hash(F.col("form"), lambda k: F.get("kind", F.lit(k))))


def _small(known: DataFrame) -> DataFrame:
    return F.broadcast(known) if known.limit(BROADCAST + 1).count() <= BROADCAST else known


def _hash(form: Column, token) -> Column:
    """Hash of a window, given its words by number; words beyond a short window are null."""
    return F.xxhash64(form, F.xxhash64(token(0), token(1)), F.xxhash64(token(2), token(3)))


def _at(tokens: Column, i: Column, size: int):
    return lambda k: F.get(tokens, i + k) if k < size else F.lit(None).cast("string")


def _hashes(form: int, tokens: str, size: int) -> Column:
    """Hashes of all windows of a form: from those of pairs of neighbours, which are cheaper than four look-ups a window."""
    if size < WINDOW:
        return F.transform(_starts(F.col(tokens), size), lambda i: _hash(F.lit(form), _at(F.col(tokens), i, size)))
    rest = lambda column, k: F.slice(column, k + 1, F.size(column))
    pairs = f"{tokens}_pairs"
    fours = F.zip_with(pairs, rest(pairs, 2), lambda x, y: F.xxhash64(F.lit(form), x, y))
    return F.when(F.size(tokens) >= WINDOW, F.slice(fours, 1, F.greatest(F.size(tokens) - (WINDOW - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """k1 and k2 of the documents that share as many windows with the benchmark as an item needs."""
    specs = sorted((r["form"], r["size"]) for r in known.select("form", "size").distinct().collect())
    marks = known.groupBy("w").agg(F.min("need").alias("need"))
    split = forms(docs, "text")
    split = split.withColumn("low", F.transform("words", lambda w: F.lower(F.regexp_replace(w, ",", "")))) if any(form == VERBATIM for form, _ in specs) else split
    tokens = {TYPED: "typed", PLAIN: "plain", VERBATIM: "low"}
    if not specs:
        return docs.select(*KEY).limit(0)
    for form in {form for form, size in specs if size == WINDOW}:
        name = tokens[form]
        split = split.withColumn(f"{name}_pairs", F.zip_with(name, F.slice(name, 2, F.size(name)), lambda x, y: F.xxhash64(x, y)))
    hashes = [_hashes(form, tokens[form], size) for form, size in specs]
    hits = split.select(*KEY, F.explode(F.concat(*hashes)).alias("w")).join(_small(marks), "w")
    return hits.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("need").alias("need")).where(F.col("n") >= F.least("need", F.lit(2))).select(*KEY)


def _consistent(pairs: Column) -> Column:
    """Each value of the item stands for one value of the document, and the other way round."""
    sides = [F.size(F.array_distinct(pairs[side])) for side in ("theirs", "own")]
    return (F.size(pairs) == sides[0]) & (F.size(pairs) == sides[1])


def _slots() -> Column:
    """Pairs of the item's and the document's values of the slots, but for names at the item's edges."""
    edge = lambda k: ((F.col("item_at") == 0) & (k == 0)) | ((F.col("item_at") == F.col("last")) & (k == F.col("size") - 1))
    pair = lambda kind, k: F.struct(F.concat(kind, F.get("theirs", k)).alias("theirs"), F.concat(kind, F.get("own", k)).alias("own"))
    slot = lambda kind, k: kind.isin(NUMBER, UNIT) | ((kind == NAME) & ~edge(k))
    return F.when(F.col("form") == VERBATIM, F.array().cast("array<struct<theirs:string,own:string>>")).otherwise(F.filter(F.transform("kind", lambda kind, k: F.when(slot(kind, k), pair(kind, k))), lambda x: x.isNotNull()))


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """k1, k2, doc_id, item_id, matched windows, windows the item offers, and distinct slots, for every leak."""
    known = checkpoint(items_of(benchmark, item_col, item_text_col))
    docs = keyed(df, id_col, text_col)
    few = docs.join(_small(checkpoint(candidates(docs, known))), KEY, "left_semi")
    own = _with_values(forms(few, "text").drop("text"))
    spot = lambda size: F.transform(_starts(F.col("tokens"), size), lambda i: F.struct(i.alias("at"), _hash(F.col("form"), _at(F.col("tokens"), i, size)).alias("w"), F.slice("values", i + 1, size).alias("own")))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    if not sizes:
        return few.select(*KEY, "doc_id", F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("matched", "room", "slots")]).limit(0)
    places = own.select(*KEY, "doc_id", F.explode(F.concat(*map(spot, sizes))).alias("s")).select(*KEY, "doc_id", "s.*")
    together = (
        places.join(_small(known), "w").withColumn("pairs", _slots())
        .groupBy(*KEY, "item_id", "copy", "form", "offered", "need", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.min("doc_id").alias("doc_id"), F.countDistinct("item_at").alias("matched"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    )
    full = together.where(F.col("matched") >= F.col("need")).withColumn("share", F.col("matched") / F.col("offered")).withColumn("good", _consistent(F.col("pairs")))
    taken = F.when(F.col("good"), F.struct("matched", F.col("offered").alias("room"), F.size("pairs").alias("slots")))
    best = full.groupBy(*KEY, "item_id").agg(
        F.min("doc_id").alias("doc_id"), F.max(F.when(F.col("form") != PLAIN, taken)).alias("first"), F.max(F.when(F.col("form") == PLAIN, taken)).alias("second"),
        F.max(F.when(F.col("good") & (F.col("form") == PLAIN), F.col("share"))).alias("plain"), F.max(F.when(~F.col("good"), F.col("share"))).alias("mixed"),
    )
    second = F.when(F.col("mixed").isNull() | (F.col("plain") >= F.col("mixed")), F.col("second"))
    best = best.withColumn("best", F.greatest("first", second)).where("best IS NOT NULL")
    return best.select(*KEY, "doc_id", "item_id", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("matched", "room", "slots")])


def contaminated(df: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """doc_id, item_id, matched, room and slots of every leak; one row for each text of an identifier and item."""
    return leaks(df, benchmark, **names).select("doc_id", "item_id", "matched", "room", "slots")


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no leak."""
    return with_row(df, id_col, text_col).join(leaks(df, benchmark, id_col, text_col).select(*KEY).distinct(), KEY, "left_anti").select("row.*")


def oracle_sql() -> str:
    """The same search over ``documents`` and ``benchmark`` for DuckDB, without the first step."""
    units = ", ".join(repr(u) for u in UNITS)
    kind = lambda names: f"CASE WHEN regexp_matches(x, '^\\p{{N}}') THEN '{NUMBER}' {names}WHEN lower(x) IN ({units}) THEN '{UNIT}' ELSE lower(x) END"
    named = f"WHEN regexp_matches(x, '^\\p{{Lu}}') THEN '{NAME}' "
    # RE2 has no look-around: points and commas between digits are marked first, twice since matches do not overlap
    mark = lambda c, sign, to: f"regexp_replace(regexp_replace({c}, '(\\p{{N}})[{sign}](\\p{{N}})', '\\1{to}\\2', 'g'), '(\\p{{N}})[{sign}](\\p{{N}})', '\\1{to}\\2', 'g')"
    marked = mark(mark("coalesce(text, '')", ",", "\x01"), ".", "\x02")
    words = f"list_transform(list_filter(string_split(regexp_replace({marked}, '[^\\p{{L}}\\p{{N}}\\x01\\x02]+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: replace(replace(x, chr(1), ','), chr(2), '.'))"
    slot = f"('{NUMBER}', '{NAME}', '{UNIT}')"
    head = f"list_filter(range(1, len(each) + 2), lambda i: i = len(each) + 1 OR each[i] <> '{NAME}' OR i = 1 OR each[i - 1] <> '{NAME}')"
    shape = lambda source, key: f"""SELECT {key}, {words} AS words FROM {source}"""
    each = lambda table, key: f"""SELECT {key}, list_transform(words, lambda x: {kind(named)}) AS each, list_transform(words, lambda x: {kind('')}) AS plain, list_transform(words, lambda x: lower(replace(x, ',', ''))) AS low FROM {table}"""
    rows = lambda table, key: f"""SELECT {key}, {TYPED} AS form, list_transform(range(1, len(head)), lambda j: each[head[j]]) AS tokens, list_transform(range(1, len(head)), lambda j: array_to_string(list_slice(low, head[j], head[j + 1] - 1), '_')) AS vals FROM (SELECT *, {head} AS head FROM {table}) WHERE len(each) > 0
UNION ALL SELECT {key}, {PLAIN}, plain, low FROM {table} WHERE len(low) > 0 UNION ALL SELECT {key}, {VERBATIM}, low, low FROM {table} WHERE len(low) > 0"""  # noqa: E731
    return f"""
WITH iw AS ({shape("(SELECT DISTINCT item_id, text FROM benchmark)", "item_id, text AS copy")}), ie AS ({each("iw", "item_id, copy")}), i AS ({rows("ie", "item_id, copy")}),
cut AS (SELECT *, least(len(tokens), {WINDOW}) AS size, len(tokens) AS n, unnest(range(0, greatest(len(tokens) - {WINDOW}, 0) + 1)) AS item_at FROM i),
win AS (SELECT item_id, copy, form, size, n, item_at, n - size AS last, list_slice(tokens, item_at + 1, item_at + size) AS kind, list_slice(vals, item_at + 1, item_at + size) AS theirs FROM cut),
usable AS (SELECT *, count(*) OVER (PARTITION BY item_id, copy, form) AS offered FROM win WHERE form = {VERBATIM} OR len(list_filter(kind, lambda x: x NOT IN {slot})) >= {LITERAL}),
fine AS (SELECT *, offered >= CASE WHEN n >= {SHORTEST} THEN 2 ELSE 1 END AS enough FROM usable),
marked AS (SELECT *, bool_or(form = {TYPED} AND enough) OVER (PARTITION BY item_id, copy) AS strong FROM fine),
known AS (SELECT *, CASE WHEN n < {SHORTEST} OR form = {VERBATIM} THEN offered ELSE greatest(2, offered // 2) END AS need FROM marked WHERE CASE WHEN form = {VERBATIM} THEN NOT strong ELSE enough END),
dw AS ({shape("documents", "doc_id")}), de AS ({each("dw", "doc_id")}), d AS ({rows("de", "doc_id")}),
sizes AS (SELECT DISTINCT size FROM known),
spots AS (SELECT doc_id, form, tokens, vals, size, unnest(range(0, len(tokens) - size + 1)) AS pos FROM d, sizes WHERE len(tokens) >= size),
dwin AS (SELECT doc_id, form, size, pos, list_slice(tokens, pos + 1, pos + size) AS kind, list_slice(vals, pos + 1, pos + size) AS own FROM spots),
hits AS (SELECT doc_id, item_id, copy, form, offered, need, pos - item_at AS shift, item_at, CASE WHEN form = {VERBATIM} THEN [] ELSE list_filter(list_transform(range(1, size + 1), lambda k: CASE WHEN kind[k] IN ('{NUMBER}', '{UNIT}') OR (kind[k] = '{NAME}' AND NOT (item_at = 0 AND k = 1) AND NOT (item_at = last AND k = size)) THEN {{'a': kind[k] || theirs[k], 'b': kind[k] || own[k]}} END), lambda x: x IS NOT NULL) END AS pairs FROM dwin JOIN known USING (form, size, kind)),
grouped AS (SELECT doc_id, item_id, copy, form, offered, need, shift, count(DISTINCT item_at) AS matched, list_distinct(flatten(list(pairs))) AS pairs FROM hits GROUP BY ALL),
whole AS (SELECT *, len(pairs) AS slots, matched / offered AS share, len(pairs) = len(list_distinct(list_transform(pairs, lambda p: p.a))) AND len(pairs) = len(list_distinct(list_transform(pairs, lambda p: p.b))) AS fits FROM grouped WHERE matched >= need),
sides AS (SELECT *, max(CASE WHEN NOT fits THEN share END) OVER pair AS mixed, max(CASE WHEN fits AND form = {PLAIN} THEN share END) OVER pair AS plainly FROM whole WINDOW pair AS (PARTITION BY doc_id, item_id)),
good AS (SELECT * FROM sides WHERE fits AND (form <> {PLAIN} OR mixed IS NULL OR plainly >= mixed)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, offered DESC, slots DESC) AS k FROM good)
SELECT doc_id, item_id, matched::BIGINT AS matched, offered::BIGINT AS room, slots::BIGINT AS slots FROM ranked WHERE k = 1"""
