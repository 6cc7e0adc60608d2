"""End-to-end plans: load -> profile -> clean -> preprocess -> features.

``delay_stages`` returns every intermediate of the delay pipeline.  Two
intermediates are written to the checkpoint folder: the cleaned table (read by
the quantile jobs and every later stage) and the featured table (read by every
report and model stage), so no report replays the remark join, the
de-duplication shuffle or the label-encoding joins.

The remarks, nearly all bytes of a ticket, are set aside: no table that is written holds
one per ticket.  Those of the derived tickets are kept in a table of texts, each once,
and the frames that return them (``raw``, ``clean``, ``preprocessed``, ``featured``) join
them by their place there when they are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import schema as S
from ticketlens.operators.clean import clean_data, preprocess_data, with_remarks
from ticketlens.plans.features import FeatureInfo, engineer_features
from ticketlens.session import materialize, release
from ticketlens.sources.io import nan_to_null
from ticketlens.sources.tickets import TICKET_COLUMNS, join_texts, numbered_texts, numbered_tickets, read_table


@dataclass
class DelayStages:
    raw: DataFrame
    clean: DataFrame
    clean_stats: dict
    preprocessed: DataFrame
    featured: DataFrame
    info: FeatureInfo
    clean_rows: DataFrame                # cleaned, with ``S.HELD`` instead of the remarks where they are set aside
    featured_rows: DataFrame             # featured, without the remarks: what reports and models read
    loaded: DataFrame | None = None      # the loaded table with ``S.ROW``
    tables: list[DataFrame] = field(default_factory=list)


#: stages by (application, folder, state of its tables); the oldest go beyond this many
_CACHE: dict[tuple, DelayStages] = {}
CACHE_SIZE = 4


def table_state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Length and time of every file of the named tables: new data under an old path is a new state."""
    sc = spark.sparkContext
    out = []
    for name in names:
        p = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        if fs.exists(p):
            out += sorted((name, s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))
    return tuple(out)


def clear_stages() -> None:
    """Forget all stages and delete the tables that were written for them."""
    while _CACHE:
        _forget(next(iter(_CACHE)))


def _forget(key: tuple) -> None:
    st = _CACHE.pop(key)
    release(*st.tables)


def delay_stages_from(raw: DataFrame, threshold_hours: float = 24.0, formats=None, row: str | None = None,
                      texts: DataFrame | None = None) -> DelayStages:
    """``row`` numbers the rows of a written table, whose remarks are then set aside; ``texts`` holds them where the numbers name a place there."""
    raw = nan_to_null(raw)
    clean, stats = clean_data(raw, formats=formats, row=row)
    pre = preprocess_data(clean)
    featured, info = engineer_features(pre, True, S.TARGET, threshold_hours)
    # the featured table feeds every report and the model stages: write it once
    featured = materialize(featured)
    if row is None:
        return DelayStages(raw, clean, stats, pre, featured, info, clean, featured.drop(S.REMARKS), tables=[clean, featured])
    return DelayStages(raw.drop(row), with_remarks(clean, raw, row, texts=texts), stats, with_remarks(pre, raw, row, lower=True, texts=texts),
                       with_remarks(featured, raw, row, lower=True, texts=texts), info, clean, featured.drop(S.HELD), raw, [clean, featured])


def delay_stages(spark: SparkSession, sf_dir: str) -> DelayStages:
    """Stages for the derived ticket table of ``sf_dir`` (memoised per session)."""
    key = (spark.sparkContext.applicationId, sf_dir, table_state(spark, sf_dir, "events", "documents"))
    if key not in _CACHE:
        while len(_CACHE) >= CACHE_SIZE:
            _forget(next(iter(_CACHE)))
        # the loaded table is written once (as the reference loads its CSV once), its texts apart:
        # profiling, de-duplication and the raw-row queries all read it
        texts = materialize(numbered_texts(read_table(spark, sf_dir, "documents")), "texts")
        rows = materialize(numbered_tickets(read_table(spark, sf_dir, "events"), texts, S.ROW, {"numbers": True}), "tickets")
        loaded = join_texts(rows, S.ROW, texts).select(*[F.col("_text").alias(c) if c == S.REMARKS else c for c in TICKET_COLUMNS], S.ROW)
        st = delay_stages_from(loaded, row=S.ROW, texts=texts)
        st.raw, st.loaded = loaded.drop(S.ROW), loaded
        st.tables += [rows, texts]
        _CACHE[key] = st
    return _CACHE[key]


def numbered(raw: DataFrame) -> DataFrame:
    """The loaded table with ``S.ROW`` that the raw frame of some stages comes from; any other frame as it is."""
    return next((st.loaded for st in _CACHE.values() if st.raw is raw and st.loaded is not None), raw)


def featured_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delay_stages(spark, sf_dir).featured
