"""Versions with several writers, the stored index, the base rows, and streams into the engine."""

import pytest
from pyspark.sql import functions as F

from monthwise.functions import scalars
from monthwise.operators import base, months, postings, relational, search
from monthwise.plans.engine import COLUMNS, Engine
from monthwise.plans.versions import Conflict, Version, Versions
from monthwise.sources import statements
from monthwise.streaming import refresh


def of(spark, n, rows, start="2022-09-01"):
    return statements.to_transactions(statements.synthetic(spark, months=n, rows_a_month=rows, start=start))


@pytest.fixture
def engine(spark, tmp_path):
    out = Engine(spark, str(tmp_path / "e"))
    out.ingest(statements.synthetic(spark, months=4, rows_a_month=25))
    return out


def rows(df):
    return sorted(map(str, df.collect()))


def agrees(engine):
    """Every layer is what a rebuild of the transactions would make."""
    t = engine.transactions()
    assert rows(engine.months().select(*months.month_gold(t).columns)) == rows(months.month_gold(t))
    assert rows(engine.base().select(*base.base(t).columns)) == rows(base.base(t))
    texts = t.select("id", "ym", scalars.chunk_text(F.col("id"), ["date", "description", "category", "amount", "balance"]).alias("content"))
    assert rows(engine.chunks().select("id", "ym", "content")) == rows(texts)
    index = engine._layer("postings")
    assert rows(index.select("id", "token", "tf")) == rows(postings.postings(texts).select("id", "token", "tf"))
    exact = {(r["anchor"], r["window"]): r for r in months.periods_exact(t).collect()}
    assert {(r["anchor"], r["window"]): r["count"] for r in engine.periods().collect()} == {k: r["count"] for k, r in exact.items()}
    for question in ("netflix", "city metro upi", "rent 2022", "nothing at all"):
        assert engine.keyword_search(question, 8).collect() == search.bm25(texts, question, 8).collect()


def test_keyword_search_from_postings_before_and_after_a_change(spark, engine):
    agrees(engine)
    engine.update_month("2022-10", of(spark, 1, 7, "2022-10-01"))
    agrees(engine)
    engine.update_month("2022-11", of(spark, 1, 1).limit(0))
    agrees(engine)
    assert engine.keyword_search("?!").collect() == [] and engine.month_count("2022-10") == 7 and engine.month_count("2022-11") == 0
    assert engine.has_month("2022-10") and not engine.has_month("2022-11") and not engine.is_empty()


def test_a_question_reads_the_folders_of_its_words(spark, engine):
    wanted = {f"bucket={spark.range(1).select(postings.bucket(F.lit(t))).first()[0]}" for t in ("netflix", "spotify")}
    plan = engine.keyword_search("Netflix, Spotify")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan
    version = engine.versions.last()
    found = engine._layer("postings", version).where(F.col("token").isin("netflix", "spotify")).where(F.col("bucket").isin(*(int(w[7:]) for w in wanted)))
    assert found.count() > 0 and {r[0].split("/")[-2] for r in spark.read.parquet(f"{next(iter(version.months.values()))}/postings").where(F.col("token").isin("netflix", "spotify")).select("_metadata.file_path").distinct().collect()} == wanted


def test_base_rows_answer_as_the_transactions_do(spark, engine):
    t, b = engine.transactions(), engine.base()
    assert base.overview(b).collect() == relational.overview(t).collect()
    assert base.spending(b, "category", 8).collect() == relational.category_breakdown(t).collect()
    assert base.spending(b, "payee", 6).collect() == relational.top_payees(t).collect()
    assert base.subscriptions(b).collect() == relational.subscriptions(t).collect()
    assert base.subscriptions_total(b).collect() == relational.subscriptions_total(t).collect()
    assert base.current_balance(b).collect() == relational.current_balance(t).collect()
    assert rows(base.spending(b, "ym").select("ym", "spend")) == rows(relational.monthly_spend(t).select("ym", "spend"))
    board = engine.dashboard()
    assert board["recent"] == [r.asDict() for r in relational.recent(t).collect()] and board["overview"][0]["count"] == 100
    assert engine._latest(12).select("ym").distinct().count() == 1  # of four months


def test_month_gold_reads_the_table_once(spark, tmp_path):
    of(spark, 3, 40).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = months.month_gold(t)._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("FileScan") == 1


def test_two_writers_lose_nothing(spark, engine):
    other = Engine(spark, engine.folder)
    since = engine.versions.last()
    other.update_month("2022-10", of(spark, 1, 3, "2022-10-01"))
    engine._change(of(spark, 1, 5, "2022-11-01"), {"2022-11"}, since=since)  # begun before the other one's
    counts = {r["ym"]: r["count"] for r in engine.months().collect()}
    assert counts == {"2022-09": 25, "2022-10": 3, "2022-11": 5, "2022-12": 25} and engine.versions.last().number == since.number + 2
    agrees(engine)
    with pytest.raises(Conflict, match="2022-11"):
        other._change(of(spark, 1, 9, "2022-11-01"), {"2022-11"}, since=since)
    with pytest.raises(Conflict):
        other._change(of(spark, 1, 9), since=since)
    assert {r["ym"]: r["count"] for r in engine.months().collect()} == counts


def test_a_number_is_made_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.last() == Version() and v.publish(Version(1, {"2022-09": "a"}, "w"))
    assert not v.publish(Version(1, {"2022-09": "b"}, "x")) and v.last() == Version(1, {"2022-09": "a"}, "w")
    assert v.publish(Version(2, {}, "y")) and v.numbers() == [1, 2] and v.last().months == {}
    assert Version(1, {"a": "1", "b": "2"}).changed(Version(2, {"a": "1", "c": "3"})) == {"b", "c"}


def test_clean_up_leaves_readers_alone(spark, engine):
    reader = engine.transactions()
    before = rows(reader)
    engine.update_month("2022-10", of(spark, 1, 3, "2022-10-01"))
    assert engine.clean_up(older_than=3600) == [] and engine.clean_up(older_than=0) == [] and rows(reader) == before
    engine.rebuild()
    assert engine.clean_up(keep=2, older_than=3600) == ["commits/version=1"]
    gone = engine.clean_up(keep=1, older_than=0)
    assert "commits/version=2" in gone and sum(x.startswith("data/") for x in gone) == 2
    assert engine.transactions().count() == 78 and engine.versions.numbers() == [3]
    agrees(engine)


def test_a_stream_into_versions(spark, engine, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    new = of(spark, 2, 20, "2022-12-01")
    parts = [new.where("pmod(id, 2) = 0"), new.where("pmod(id, 2) <> 0")]

    def run():
        refresh.refresh(engine, spark.readStream.schema(new.schema).parquet(source), checkpoint).awaitTermination()

    parts[0].write.mode("append").parquet(source)
    run()
    assert engine.transactions().count() == 100 + parts[0].count()
    parts[0].write.mode("append").parquet(source)  # rows that repeat
    parts[1].write.mode("append").parquet(source)
    run()
    assert engine.transactions().count() == 140
    number = engine.versions.last().number
    run()  # nothing new
    assert not engine.apply(parts[1], "transactions", 0) and engine.versions.last().number == number
    late = of(spark, 1, 4, "2021-01-01")
    late.write.mode("append").parquet(source)
    run()
    assert engine.has_month("2021-01") and engine.transactions().count() == 144
    moved = late.limit(1).withColumn("date", F.lit("2022-09-09")).withColumn("ym", F.lit("2022-09"))
    moved.unionByName(moved.withColumn("date", F.lit("2022-09-01"))).select(*COLUMNS).write.mode("append").parquet(source)
    run()
    assert engine.transactions().count() == 144 and engine.month_count("2021-01") == 3 and engine.month_count("2022-09") == 26
    assert engine.transactions().where("date = '2022-09-09'").where(F.col("id") == moved.first()["id"]).count() == 1
    agrees(engine)


def test_fields_of_odd_descriptions(spark):
    odd = ["Shop; amount: 5 - a", "a;b", "back\\slash; x", ";\\ y", "plain", "\\e"]
    df = spark.createDataFrame([(i, d, "1.50") for i, d in enumerate(odd)], "id long, description string, amount string")
    chunks = df.select("id", scalars.chunk_text(F.col("id"), ["description", "amount"]).alias("content"))
    f = scalars.chunk_fields(F.col("content"))
    assert [(r[0], r[1]) for r in chunks.orderBy("id").select(f["description"], f["amount"]).collect()] == [(d, 1.5) for d in odd]


def test_contextual_chunks_are_preferred(spark, engine):
    r = engine.chunks().first()
    assert r["contextual"].startswith("Bank statement | Category: ") and r["contextual"].endswith(r["content"])
    vector = search.HashingEmbedder().embed(spark.createDataFrame([(r["contextual"],)], "content string")).first()["embedding"]
    assert vector == pytest.approx(r["contextual_embedding"]) and engine.semantic_search(r["contextual"], 1).first()["id"] == r["id"]
