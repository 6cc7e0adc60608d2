"""Remarks that are set aside: no intermediate of the ticket stages holds a text, and every frame is as with them."""
from pyspark.sql import functions as F

from ticketlens import schema as S
from ticketlens.operators.clean import clean_data, with_remarks
from ticketlens.plans.pipelines import delay_stages_from
from ticketlens.session import materialize
from ticketlens.sources.tickets import build_tickets


def _loaded(spark):
    n = F.col("id")
    events = spark.range(400).select(
        n.alias("event_id"), (n % 23).alias("user_id"), F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("x")), (n % 3 + 1).cast("int")).alias("event_type"),
        ((n * 37) % 101 / 3.0).alias("value"), F.timestamp_seconds(F.lit(1_700_000_000) + n * 5000).alias("ts"),
        F.concat(F.lit('{"k": '), (n % 31).cast("string"), F.lit("}")).alias("props"))
    docs = spark.createDataFrame([(0, "Urgent: broken"), (1, None), (2, "unknown"), (3, "Unknown"), (4, "ASAP İΣ"), (5, "fine")], "doc_id long, text string")
    raw = build_tickets(events, docs)
    twin = raw.where("unique_id = '7'").withColumn(S.REMARKS, F.lit("another remark"))           # one id, other remarks
    return materialize(raw.unionByName(twin).withColumn(S.ROW, F.monotonically_increasing_id()), "loaded")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_stages_are_as_with_the_remarks(spark):
    loaded = _loaded(spark)
    plain, aside = delay_stages_from(loaded.drop(S.ROW)), delay_stages_from(loaded, row=S.ROW)
    assert aside.clean_stats == plain.clean_stats and aside.clean_stats["customer_remarks_filled"] > 0
    assert aside.info == plain.info
    for name in ("raw", "clean", "preprocessed", "featured"):
        a, b = getattr(aside, name), getattr(plain, name)
        assert a.columns == b.columns and _rows(a) == _rows(b), name
    assert _rows(aside.featured_rows) == _rows(plain.featured.drop(S.REMARKS))


def test_written_tables_hold_no_remarks(spark):
    st = delay_stages_from(_loaded(spark), row=S.ROW)
    assert all(S.REMARKS not in t.columns for t in (*st.tables, st.clean_rows, st.featured_rows))


def test_copies_stay_without_de_duplication(spark):
    loaded = _loaded(spark)
    plain, _ = clean_data(loaded.drop(S.ROW), dedup=False)
    aside, _ = clean_data(loaded, dedup=False, row=S.ROW)
    assert _rows(with_remarks(aside, loaded, S.ROW)) == _rows(plain)


def test_texts_are_written_once_and_rows_are_as_joined(spark, tmp_path, monkeypatch):
    """Documents that come twice, without an id or without a text; no table holds a text per ticket."""
    from ticketlens.plans import pipelines as P
    from ticketlens.sources.tickets import tickets
    n = F.col("id")
    spark.range(300).select(
        n.alias("event_id"), (n % 23).alias("user_id"), F.lit("click").alias("event_type"), ((n * 37) % 101 / 3.0).alias("value"),
        F.timestamp_seconds(F.lit(1_700_000_000) + n * 5000).alias("ts"), F.concat(F.lit('{"k": '), (n % 31).cast("string"), F.lit("}")).alias("props")
    ).write.parquet(str(tmp_path / "events.parquet"))
    docs = [(0, "Urgent"), (1, None), (2, "Two"), (2, "Two"), (3, "ASAP"), (3, "other"), (None, "lost"), (4, "x" * 5000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    written, write = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, *a: written.append(write(df, *a)) or written[-1])
    st = P.delay_stages(spark, str(tmp_path))
    raw = tickets(spark, str(tmp_path))
    assert st.raw.columns == raw.columns and _rows(st.raw) == _rows(raw)
    seen = _rows(raw.select(S.UNIQUE_ID, F.coalesce(S.REMARKS, F.lit("Unknown")).alias(S.REMARKS)).distinct())
    assert _rows(st.clean.select(S.UNIQUE_ID, S.REMARKS).distinct()) == seen
    long_texts = sum(t.where(F.length(c) >= 5000).count() for t in written for c, kind in t.dtypes if kind == "string")
    assert long_texts == 1
    assert P.numbered(st.raw) is st.loaded and P.numbered(raw) is raw
