"""Licence scan and decontamination: defined cases, SQL on a table, plain versions."""

import random
import re
import textwrap

import duckdb
import pytest

from quietframe.llm import decontamination as dc
from quietframe.llm import licences


def same(spark_df, sql, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(sql)
    cols = sorted(spark_df.columns)
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r) for r in spark_df.select(cols).collect()) == key(con.sql(f"select {', '.join(cols)} from ({sql})").fetchall())
    return want


@pytest.mark.parametrize("which", ["licence", "leak"])
def test_against_sql(spark, which):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    if which == "licence":
        same(licences.scan(docs), licences.oracle_sql(), folder)
    else:
        same(dc.contaminated(docs, items), dc.oracle_sql(), folder)


def test_licences(spark):
    mit = licences.WHOLE["MIT"]
    rows = [
        (1, "MIT License\n".replace("MIT License\n", "") + "Copyright (c) 2020 Some Body\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence")),
        (2, mit + " and one more word"), (3, "text\n  Released under the MIT Licence!\nLicensed under CC BY-NC 4.0\nmore"), (4, None), (5, ""), (6, "(c) me\nAll rights reserved."), (6, "(c) me\nAll rights reserved."), (None, "SPDX-License-Identifier: ISC"),
    ]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, licence string, digest int")
    got = sorted([(r.doc_id, r.licence, r.notices, r.n_notices) for r in licences.scan(df).collect()], key=str)
    assert got == sorted([(1, "MIT", "", 0), (2, None, "", 0), (3, None, "CC-BY-NC-4.0,MIT", 2), (4, None, "", 0), (5, None, "", 0), (6, None, "", 0), (6, None, "", 0), (None, None, "ISC", 1)], key=str)
    assert licences.scan(df.limit(0)).collect() == []


ITEM = "A train leaves Paris at 10 with 250 people and Anna counts each of the 40 km until it stops in Rome where Anna gets off"


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_leaks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dc, "BROADCAST", broadcast)
    renamed = ITEM.replace("Anna", "Bruno").replace("Paris", "Lima").replace("250", "17").replace("40 km", "9 miles")
    mixed = ITEM.replace("Anna", "Bruno", 1)  # one name for two
    other = "quite another text about the weather of these days that says nothing of the kind and goes on"
    rows = [(i, pre + text + post) for i, (pre, text, post) in enumerate([("", ITEM, ""), (other + " ", renamed, " " + other), ("x ", renamed.replace(" ", " %%% "), ""), (other, " " + mixed, ""), ("", other, ""), ("", "of the 40 km until it", ""), ("", "", "")])]
    rows += [(7, None), (0, ITEM), (None, "so " + ITEM), (8, other + " " + ITEM.upper()), (9, ITEM.lower() + "!!")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM, "a"), (2, None, "b"), (3, "too short a text", "c"), (4, "", "d")], "item_id long, text string, own string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (8, 1), (9, 1), (None, 1)}
    left = dc.clean(df, items)
    assert left.columns == df.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == ["3", "4", "5", "6", "7"]
    assert dc.contaminated(df.limit(0), items).collect() == [] and dc.contaminated(df, items.limit(0)).collect() == []


SUM = "Compute 12 + 7 * 3 - 45 / 9 + 6 for x = 2 and y = 5"
PRICE = "a shop sells 950 apples to a man called Anna who then eats half of them before going home again"


@pytest.mark.parametrize("offset", range(4))
def test_leaks_of_items_with_many_slots(spark, offset):
    lead = "so it was told here ".split()[:offset]
    texts = [SUM, SUM.replace("12", "31"), "how many legs has a cow", PRICE.replace("950", "1,250"), PRICE.replace("Anna", "Maria Luisa Bruno"), "7 8 9", "Compute 12 for x and nothing else in this text of words", "quite another text, 7 9 8"]
    df = spark.createDataFrame([(i, " ".join([*lead, t, "and", "on"])) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, SUM), (2, "How many legs has a cow?"), (3, PRICE), (4, "7 8 9")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 2), (3, 3), (4, 3), (5, 4)}
    assert {r.doc_id for r in dc.clean(df, items).collect()} == {6, 7}


@pytest.mark.parametrize("one,two", [("All rights reserved at the hotel.", "All rights reserved in the house."), ("Copyright law is difficult.", "Copyright is a right."), ("Copyrighted works of art", "copyright or not")])
def test_lines_about_copyright_are_no_statements(spark, one, two):
    rows = licences.scan(spark.createDataFrame([(1, one), (2, two), (3, ""), (4, "Copyright (c) 2020 A. Body. All rights reserved.")], "doc_id long, text string")).collect()
    digest = {r.doc_id: r.digest for r in rows}
    assert digest[1] != digest[2] and digest[3] not in (digest[1], digest[2]) and digest[3] == digest[4]


@pytest.mark.parametrize("width", [20, 33, 60, 72, 79, 120])
def test_wrapping_does_not_matter(spark, width):
    rows = [(i, "Copyright 2021 Some Body\n" + "\n".join(textwrap.wrap(t, width, break_long_words=False)), k) for i, (k, t) in enumerate(licences.WHOLE.items())]
    got = licences.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    assert {r.doc_id: r.licence for r in got.collect()} == {r[0]: r[2] for r in rows}


def test_very_long_texts(spark):
    line = "some words of a line of text that goes on, 12 of them or 1,250\n"
    rows = [(1, line * 30_000 + "Released under the MIT License\n" + ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert licences.scan(docs).first().notices == "MIT"
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [r.item_id for r in dc.contaminated(docs, items).collect()] == [1]


def changed(rng, text):
    """The question with other numbers and names, each the same everywhere."""
    new = {}
    for w in re.findall(r"\d+|[A-Z][a-z]+", text):
        new.setdefault(w, str(rng.randrange(2, 9999)) if w.isdigit() else " ".join(rng.choice(["Lima", "Oslo", "Bob", "Ada", "New Haven", "Kim"]) + rng.choice("aeiou") for _ in range(rng.randrange(1, 3))))
    return re.sub(r"\d+|[A-Z][a-z]+", lambda m: new[m.group(0)], text), len(set(new.values())) == len(new)


def test_recall_of_changed_questions(spark):
    """Planted questions with other numbers and names between other sentences are found; texts without them are not."""
    rng = random.Random(8)
    verbs, things = ["buys", "sells", "counts", "eats", "finds", "breaks"], ["apples", "books", "stones", "chairs", "birds", "maps"]
    items, docs = [], []
    for i in range(40):
        a, b = rng.sample(["Anna", "Peter", "Maria", "John", "Sara"], 2)
        x, y = rng.sample(range(2, 900), 2)
        items.append((i, f"{a} {rng.choice(verbs)} {x} {rng.choice(things)} in the {rng.choice(['old', 'new', 'small'])} shop of {b} and then {rng.choice(verbs)} {y} of them before the {rng.choice(['train', 'boat', 'bus'])} {rng.choice(['leaves', 'stops'])}, how many {rng.choice(things)} are left for {b}?"))
    filler = lambda: " ".join(rng.choice(["the", "weather", "of", "these", "days", "is", "fine", "and", "warm", "or", "not"]) for _ in range(rng.randrange(5, 40)))
    planted = 0
    for i, text in items:
        new, apart = changed(rng, text)
        planted += apart
        docs.append((i if apart else 1000 + i, f"{filler()}. {new} {filler()}"))
    docs += [(2000 + i, filler()) for i in range(40)]
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in found for i, _ in docs if i < 1000) >= 0.9 * planted > 20
    assert not any(d >= 2000 for d, _ in found)


@pytest.mark.parametrize("item", ["What is the capital of France?", "Who wrote it?", "Solve 3 x", "Name two rivers of Spain"])
def test_short_items_are_found_at_any_place(spark, item):
    rows = [(k, " ".join(["word"] * k) + " " + item.upper() + " and so on") for k in range(6)] + [(9, "quite another text about rivers and capitals")]
    got = {r.doc_id for r in dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == set(range(6))


def test_runs_of_names(spark):
    item = "the train from New York to San Diego carries Anna Smith and stops at noon in Los Angeles for one hour of rest"
    other = item.replace("New York", "Rome").replace("San Diego", "Lima").replace("Anna Smith", "Bob").replace("Los Angeles", "Oslo")
    got = dc.contaminated(spark.createDataFrame([(1, other), (2, "a plain text of words")], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [1]


def test_titled_wrapped_and_full_licences(spark):
    import os

    wrapped = lambda t: "\n".join(textwrap.wrap(t, 72))
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + wrapped(licences.WHOLE["MIT"]), "MIT"), (2, "BSD 3-Clause License\n\nCopyright (c) 2020, Some Body\nAll rights reserved.\n\n" + wrapped(licences.WHOLE["BSD-3-Clause"]), "BSD-3-Clause"), (3, "MIT License\n", None), (5, licences.WHOLE["BSD-2-Clause"].replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS"), "BSD-2-Clause"), (4, "# A program\nMIT License\n" + licences.WHOLE["MIT"], None)]
    folder = "/usr/share/common-licenses"
    for i, (name, licence) in enumerate((("GPL-3", "GPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"))):
        if os.path.exists(f"{folder}/{name}"):
            rows.append((10 + i, open(f"{folder}/{name}", encoding="utf-8").read(), licence))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.scan(df).collect()} == {r[0]: r[2] for r in rows}


def test_copyright_statements_without_a_year_and_over_lines(spark):
    mit, bsd = licences.WHOLE["MIT"], licences.WHOLE["BSD-3-Clause"]
    google = bsd.replace("Neither the name of the copyright holder nor", "Neither the name of Google Inc. nor")
    regents = bsd.replace("Neither the name of the copyright holder nor the names of its", "Neither the name of the University nor the names of its")
    rows = [
        (1, "Copyright Joyent, Inc. and other Node contributors.\n\n" + mit), (2, "The MIT License\n\nCopyright (c) 2010 A. Body,\n   B. Body and\n   others of the same house\n\n" + mit), (3, "Copyright 2008, Google Inc.\nAll rights reserved.\n\n" + google),
        (4, "Copyright (c) 1993\n  The Regents of somewhere\n" + regents), (5, "Copyright Some Body\n" + "word " * 300 + mit), (6, "A story.\n" + mit), (7, "Copyright Some Body\n" + mit + " And more."), (8, "Copyright Some Body"),
    ]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, headless int")
    assert {r.doc_id: r.licence for r in licences.scan(df).collect()} == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-3-Clause", 5: None, 6: None, 7: None, 8: None}


def test_statements_against_sql(spark, tmp_path):
    mit = licences.WHOLE["MIT"]
    texts = ["Copyright Some Body, Inc.\n" + mit, "MIT License\nCopyright Some\nBody\n" + mit, mit, "© me\n" + licences.WHOLE["ISC"], "Copyright of it\n" + licences.WHOLE["BSD-3-Clause"].replace("the copyright holder nor", "W3C (r) and others nor"), "x " + mit, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "none")], "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    found = licences.scan(spark.read.parquet(str(tmp_path / "documents.parquet")))
    same(found, licences.oracle_sql(), str(tmp_path))
    assert [r.licence for r in found.orderBy("doc_id").collect()] == ["MIT", "MIT", "MIT", "ISC", "BSD-3-Clause", None, None]
