"""Shared steps of normalisers are computed once a row, not once for each place that names them."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import matching as M
from quillspark.functions import text as T
from quillspark.functions.actions import parsed_action
from quillspark.operators import episodes as E

NAMES = {"date": ("initcap", 1), "person": ("split", 1), "match": ("split", 2), "f1": ("split", 4), "entity": ("split", 6), "aliases": ("initcap", 1), "action": ("upper", 1)}


@pytest.mark.parametrize("name", NAMES)
def test_steps_stand_once(spark, name):
    a, aliases, (step, most) = F.col("a"), F.col("aliases"), NAMES[name]
    column = {
        "date": lambda: T.normal_date(a), "person": lambda: T.person_core(a), "match": lambda: M.exact_match(a, aliases), "f1": lambda: M.best_alias_f1(a, aliases), "entity": lambda: E.copies_entity(a, aliases, aliases, F.lit(False)),
        "aliases": lambda: E.answer_aliases(F.create_map(F.lit("answer"), F.initcap("a")), ("answer", "answers")), "action": lambda: parsed_action(F.upper(a)),
    }[name]()
    assert 1 <= str(column).count(f"{step}(") <= most


def test_dates_as_their_formats_read_them(spark):
    texts = ["2020-01-02", "2020/01/02", "12/31/1999", "31/12/1999", "march 3, 2001", "MAR 3 2001", "3 march 2001", "03 mar 2001", "+12345-01-02", "12345-01-02", "2001-1-2", "may  5\t2010", "aprıl 5 2010", "5 ſept 2010", "31/31/2000", "on 3 march 2001",
             "march 3 2001 x", "3 -4 2001", "-3 march 2001", "february 30 2001", "0003 march 2001", "2020-01-02 ", " 1/2/2003", "٢٠٢٠-01-02", "2001", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    months = F.initcap(T.collapsed(F.translate("t", ",", " ")))
    plainly = F.coalesce(F.date_format(F.coalesce(*[F.try_to_timestamp(months, F.lit(f)) for f in T.DATE_FORMATS]), "yyyy MM dd"), F.col("t"))
    rows = df.select("t", T.normal_date(F.col("t")).alias("got"), plainly.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and sum(r["got"] != r["t"] for r in rows if r["t"]) >= 10
