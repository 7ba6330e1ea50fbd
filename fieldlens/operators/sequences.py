"""Image sequences: which images of a deployment are shown to volunteers."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import filters, naming
from fieldlens.plans.ordered import OrderedRows, ordered_rows

_DEPLOYMENT = ("deployment_id",)
_TIME_ORDER = ("ts", "media_id")


def classified(observations: DataFrame) -> DataFrame:
    """Observations that carry a decision."""
    kind = F.col("observation_type")
    return observations.where((kind != "") & (kind != "unclassified"))


def one_type_per_row(observations: DataFrame, column: str = "observation_type") -> DataFrame:
    """Observations whose type cell is a list, as one row per type."""
    return observations.withColumn(column, F.explode_outer(column))


def observation_types(observations: DataFrame) -> DataFrame:
    """Types per media file with their number. One row per (media, type), whatever a file's size."""
    return observations.groupBy("media_id", "observation_type").agg(F.count(F.lit(1)).alias("n"))


def media_with_observations(media: DataFrame, observations: DataFrame) -> DataFrame:
    """Media that have observations, with their distinct types.

    Observations are reduced to one row per media file before they meet the media, so a file with
    very many observations does not skew the join.
    """
    types = observations.groupBy("media_id").agg(
        F.array_sort(F.collect_set("observation_type")).alias("observations"),
        F.count(F.lit(1)).alias("n_observations"),
    )
    return media.join(types, "media_id")


def media_without_observations(media: DataFrame, observations: DataFrame) -> DataFrame:
    return media.join(observations.select("media_id").distinct(), "media_id", "left_anti")


def public_media(media: DataFrame) -> DataFrame:
    """Public files that show neither private people nor private vehicles."""
    return media.where("file_public AND NOT private_human AND NOT private_vehicle")


def collection_deployments(deployments: DataFrame, collections: DataFrame) -> DataFrame:
    """Deployments whose id starts with a collection's name and a dash, in any letter case.

    A name may hold dashes, so every dash-terminated prefix of the id is tried as an equality.
    """
    parts = F.split(F.lower("deployment_id"), "-")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-")
    )
    prefixed = deployments.where(F.col("deployment_id").contains("-")).withColumn(
        "_prefix", F.explode(prefixes)
    )
    names = collections.select("collection", F.lower("collection").alias("_prefix"))
    return prefixed.join(names, "_prefix").drop("_prefix")


def without_blacklisted(df: DataFrame, blacklist: Iterable[str] | DataFrame) -> DataFrame:
    """Rows outside a list of deployments, given as values or as a table."""
    if isinstance(blacklist, DataFrame):
        return df.join(blacklist, "deployment_id", "left_anti")
    return df.where(~F.col("deployment_id").isin(list(blacklist)))


def undated(media: DataFrame) -> DataFrame:
    """Media that cannot be put in a sequence."""
    return media.where(F.col("ts").isNull())


def _seconds(value: float) -> Column:
    return F.make_dt_interval(secs=F.lit(value).cast("decimal(18,6)"))


def number_sequences(rows: OrderedRows, max_interval: float) -> OrderedRows:
    """Add ``seq_id``, counting up where the gap to the previous image exceeds the interval."""
    gapped = rows.extend(previous={"_previous": F.col("ts")})
    opens = F.col("_previous").isNull() | (F.col("ts") > F.col("_previous") + _seconds(max_interval))
    numbered = gapped.extend(running={"seq_id": opens.cast("bigint")})
    return replace(numbered, rows=numbered.rows.drop("_previous"))


def gap_sequences(
    media: DataFrame, max_interval: float = 90, *, chunk_rows: int | None = None
) -> DataFrame:
    """Media with ``seq_id`` per deployment; undated media are left to :func:`undated`."""
    dated = media.where(F.col("ts").isNotNull())
    rows = ordered_rows(dated, _DEPLOYMENT, _TIME_ORDER, chunk_rows=chunk_rows)
    return number_sequences(rows, max_interval).result()


def drop_middle_humans(rows: OrderedRows) -> OrderedRows:
    """Remove images showing people from all but the first and last sequence of a deployment."""
    with_last = rows.extend(maximum={"_last_seq": F.col("seq_id")})
    middle = (F.col("seq_id") > 1) & (F.col("seq_id") < F.col("_last_seq"))
    human = F.coalesce(F.array_contains("observations", "human"), F.lit(False))
    kept = with_last.where(~(middle & human))
    return replace(kept, rows=kept.rows.drop("_last_seq"))


def is_sampled(position: Column, length: Column, n: int) -> Column:
    """Whether a 0-based position is one of n evenly spread ones: ``round(i * (length-1) / (n-1))``.

    Halves round to the even neighbour. A spread wider than one lets at most two values of i reach a
    position, so two candidates are tested instead of all n.
    """
    if n <= 1:
        return (length <= n) | (position < n)
    step = (length - 1) / F.lit(n - 1)
    first = F.floor(position / step)

    def reaches(i: Column) -> Column:
        return (i < n) & (F.rint(i.cast("double") * step) == position)

    return (length <= n) | reaches(first) | reaches(first + 1)


def sample_sequences(rows: OrderedRows, n: int) -> OrderedRows:
    """Keep n images per sequence, spread evenly; ``pos`` is the 0-based place before sampling."""
    placed = rows.regroup("deployment_id", "seq_id").extend(position="pos", total="seq_length")
    placed = placed.with_columns({"pos": F.col("pos") - 1})
    return placed.where(is_sampled(F.col("pos"), F.col("seq_length"), n))


def select_sequences(
    media: DataFrame,
    observations: DataFrame,
    *,
    deployments: Iterable[str] | None = None,
    blacklist: Iterable[str] = (),
    max_interval: float = 90,
    n_images: int = 5,
    filter_middle_humans: bool = True,
    chunk_rows: int | None = None,
) -> DataFrame:
    """The images to show to volunteers, as (deployment, sequence, position, media)."""
    wanted = media.where(filters.in_list(F.col("deployment_id"), deployments))
    if blacklist:
        wanted = without_blacklisted(wanted, blacklist)
    wanted = public_media(wanted).where(F.col("ts").isNotNull())
    joined = media_with_observations(wanted, classified(observations))
    rows = ordered_rows(joined, _DEPLOYMENT, _TIME_ORDER, sizes=wanted, chunk_rows=chunk_rows)
    rows = number_sequences(rows, max_interval)
    if filter_middle_humans:
        rows = drop_middle_humans(rows)
    label = naming.label_name(F.col("media_id"), F.col("deployment_id"), F.col("file_name"))
    return (
        sample_sequences(rows, n_images)
        .result()
        .select("deployment_id", "seq_id", "pos", "seq_length", "media_id", "ts", label.alias("label_name"))
    )


def leading_within(
    rows: DataFrame, group: list[str], order: list[str], difference: str, limit: float,
    *, chunk_rows: int | None = None,
) -> DataFrame:
    """Number the leading differences within a limit and mark the rest, per group."""
    over = (F.col(difference) > limit).cast("bigint")
    placed = ordered_rows(rows, group, order, chunk_rows=chunk_rows).extend(
        position="position", running={"_over": over}
    )
    return placed.result().withColumn("is_leading", F.col("_over") == 0).drop("_over")
