"""How much of a row is exchanged, and that results stay the same for it."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from packwise.operators import lines, tokens
from packwise.operators.ordering import dealt, number_dealt, number_within
from packwise.sources import store, text_index


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_wide_columns_are_added_after_the_exchange(spark, tmp_path):
    rows = spark.range(30_000).select(
        F.col("id").alias("inspection_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("user_no"),
        F.when(F.col("id") % 11 > 0, F.timestamp_seconds(F.col("id") * 300 + 1_700_000_000)).alias("created_at"),
    )
    laid = store.placed(rows, 4_000)
    wide = laid.withColumn("wide", F.concat(F.lit("wide"), F.repeat(F.col("inspection_id").cast("string"), 50)))
    plan = plan_of(wide)
    assert plan.count("Exchange") == 1 and plan.index("wide") < plan.index("Sort") < plan.index("Exchange")
    store.append(wide, path := str(tmp_path / "s"))
    back = store.scan(spark, path)
    assert back.select(*rows.columns).exceptAll(rows).isEmpty() and back.count() == 30_000
    assert laid.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 12_000
    kept = back.select("_metadata.file_name", "_metadata.file_block_start", "user_no", F.monotonically_increasing_id().alias("at"), "month")
    files = {}
    for r in kept.orderBy("at").collect():
        files.setdefault((r["month"], r["file_name"]), []).append(-1 if r["user_no"] is None else r["user_no"])
    assert all(users == sorted(users) for users in files.values())


def _photographed(spark):
    return spark.range(600).select(
        (F.col("id") % 100).alias("insp_no"), (F.col("id") / 100).cast("long").alias("panel_no"), (F.col("id") % 9).alias("size")
    )


def _words(panels, shift=0):
    """Rows of words as a recognizer gives them, made of dealt panels."""
    words = panels.select("insp_no", "panel_no", F.explode(F.sequence(F.lit(1), F.col("size") + 2)).alias("seq"))
    x, y = 10 + F.col("seq") * 37 % 300 + shift, 20 * (F.col("seq") % 3) + F.col("insp_no") % 5
    box = {"x_min": x, "y_min": y, "x_max": x + 30, "y_max": y + F.when(F.col("seq") == 4, 90).otherwise(18)}
    return words.select(
        "*", F.concat(F.lit("w"), F.col("seq").cast("string")).alias("text"), F.lit(0.8).alias("confidence"),
        *[c.cast("int").alias(n) for n, c in box.items()],
    )


def test_folds_exchange_panels_and_no_words(spark):
    panels = dealt(_photographed(spark), ["insp_no", "panel_no"])
    first, second = _words(panels), _words(panels, 3)
    before = _words(_photographed(spark))
    made = {
        "lines": (lines.reconstruct(first), lines.reconstruct(before)),
        "merge": (tokens.merge_passes(first, second), tokens.merge_passes(before, _words(_photographed(spark), 3))),
        "numbers": (number_dealt(_words(dealt(_photographed(spark), ["insp_no"])), ["insp_no"], ["panel_no", "seq"], F.col("panel_no"), "no"),
                    number_within(before, ["insp_no"], ["panel_no", "seq"], F.col("panel_no"), "no")),
    }
    for name, (mine, plain) in made.items():
        exchanges = [x for x in plan_of(mine).splitlines() if "Exchange" in x]
        assert all("REPARTITION_BY_NUM" in x for x in exchanges), name
        assert sorted(map(str, mine.collect())) == sorted(map(str, plain.collect())), name


def test_a_large_key_is_numbered_in_pieces(spark):
    rows = _words(_photographed(spark))
    mine = number_dealt(rows, ["insp_no"], ["panel_no", "seq"], F.col("panel_no"), "no", most=5)
    plain = number_dealt(rows, ["insp_no"], ["panel_no", "seq"], F.col("panel_no"), "no")
    assert "Join" in plan_of(mine) and "Join" not in plan_of(plain)
    assert sorted(map(str, mine.collect())) == sorted(map(str, plain.collect()))


def test_packed_lists_come_back(spark):
    rows = [(1, ["a", "", None, '"{₹,'], [("R1", None, "x"), (None, None, None), ("", "NULL", "\\\n")], [1.5]), (2, [], [], []), (3, None, None, None)]
    df = spark.createDataFrame(rows, "k int, t array<string>, r array<struct<rule_id:string,status:string,reason:string>>, d array<double>")
    lists = store.lists_of(df)
    assert list(lists) == ["t", "r"]
    moved = store.packed(df, lists)
    assert dict(moved.dtypes)["r"] == "string" and store.unpacked(moved, lists).collect() == df.collect()


def test_a_block_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(24_000).select(F.concat(F.lit("name "), (F.col("id") % 977).cast("string")).alias("name"), "id", F.array(F.lit("a")).alias("list"))
    built = text_index.build(rows, [F.col("name")], str(tmp_path / "i"), ["name", "id"], block_rows=12_000)
    kept = spark.read.parquet(f"{built.path}/records")
    sizes = {r[0]: (r[1], r[2]) for r in kept.groupBy(text_index.BLOCK).agg(F.countDistinct("_metadata.file_path"), F.count("id")).collect()}
    assert sorted(sizes) == [0, 1] and all(files > 1 and 8_000 < n < 16_000 for files, n in sizes.values())
    assert built.like(F.col("name"), "%me 97_").count() == rows.where("name like '%me 97_'").count() and kept.select("list").distinct().count() == 1


def test_panels_outside_ascii_go_their_own_way(spark):
    panels = dealt(_photographed(spark), ["insp_no", "panel_no"])

    def read(p):
        odd = (F.col("insp_no") % 3 == 0) & (F.col("seq") == 2)
        return _words(p).withColumn("text", F.when(odd, F.lit("５00 ｇ")).when(F.col("seq") == 3, None).otherwise(F.col("text")))

    mine, plain = lines.normalize(read(panels)), lines.reconstruct(tokens.filter_tokens(read(_photographed(spark))))
    assert sorted(map(str, mine.collect())) == sorted(map(str, plain.collect()))
    assert any("500 g" in r["text"] for r in mine.collect())
    only_ascii = lines.reconstruct(tokens.filter_tokens(read(panels), ascii_only=True))
    assert all("REPARTITION_BY_NUM" in x for x in plan_of(only_ascii).splitlines() if "Exchange" in x)
