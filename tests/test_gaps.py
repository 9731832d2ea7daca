"""Facts of the address rules, with literal expectations."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def test_hub_without_a_unit_requires_one():
    from addrloom.plans.sqlfunctions import address

    said = lambda *x: address(*x)[9]
    assert said("100 Wall St", "New York", "NY", "10005") == "REQUIRES_SECONDARY"
    assert said("100 Wall St Suite 200", "New York", "NY", "10005") == "DELIVERABLE"
    assert said("350 5th Ave", "New York", "NY", "10118") == "DELIVERABLE"
    assert address("350 5th Ave", "New York", "NY", "10118", frozenset(("350 5TH AVE||NEW YORK|NY|10118|USA",)))[9] == "REQUIRES_SECONDARY"


def test_mailbox_firms_are_whole_names(spark):
    from addrloom.operators.scoring import CMRA

    rows = [("THE UPS STORE 5 OAK ST", True), ("REGUS 10 ELM ST", True), ("12 REGUSA ST", False), ("123 DAVINCI DR", False), ("5 MAIN ST PMB 12", True), ("POSTAL ANNEX 4", True)]
    got = spark.createDataFrame(rows, "line string, want boolean").select(F.col("line").rlike(CMRA).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_names_two_edits_apart(spark):
    from addrloom.operators.reference import name_tokens, names_agree

    rows = [("SPRINGFIELD", "SPRNIGFEILD", True), ("SPRINGFIELD", "SPRIXGFXELD", True), ("DALLAS", "DLALSA", False), ("DALLAS", "DALLSA", True), ("ABC", "ABD", False), ("EAST SPRINGFIELD", "SPRINGFIELD", True), ("MONTGOMERY", "MXNTGXMXRY", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.withColumn("got", names_agree(name_tokens(F.col("a")), name_tokens(F.col("b")))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_accented_greek(spark):
    from addrloom.functions.layout import transliterate

    got = spark.createDataFrame([("Ερμού",), ("Αθήνα",), ("Ώρα",)], "t string").select(transliterate(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["Ermoy", "Athina", "Ora"]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
