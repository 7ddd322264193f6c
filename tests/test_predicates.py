"""Predicates on words beside letters of other alphabets."""

from pyspark.sql import functions as F

from cairnlake.functions import predicates
from cairnlake.functions.text import lines
from cairnlake.operators import code


def test_words_end_where_ascii_words_do(spark):
    rows = spark.createDataFrame([("testß",), ("ätest",), ("testing",), ("fixä",), ("äreview",), ("a_test",), ("un test.",)], "t string")
    got = {r.t: (r.i, r.g, r.d) for r in rows.select("t", predicates.mentions_invariant("t").alias("i"), predicates.mentions_gotcha("t").alias("g"), predicates.mentions_decision("t").alias("d")).collect()}
    want = {"testß": (True, False, False), "ätest": (True, False, False), "testing": (False, False, False), "fixä": (False, True, False), "äreview": (False, True, True), "a_test": (False, False, False), "un test.": (True, False, False)}
    assert got == want


def test_imports_and_exports_beside_other_letters(spark):
    rows = spark.createDataFrame([("äimport 'a'\näexport x from 'b'\nxrequire('c')\närequire('d')\nclass A {} // äexportß",)], "c string").withColumn("l", lines("c"))
    found = rows.select(F.transform(code.imports(F.col("l")), lambda i: i["module"]).alias("m"), F.transform(code.symbols(F.col("l")), lambda s: s["exported"]).alias("e")).first()
    assert (found.m, found.e) == (["a", "b", "d"], [True])
