"""quietframe: differentially private analytics declared as Spark plans."""
