"""Packages: parts limited by size, manifests, pairs of package files and the transfer ledger."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens import schema
from fieldlens.functions import filters, naming
from fieldlens.plans.ordered import ordered_rows
from fieldlens.session import stored

_DEPLOYMENT = ("collection", "deployment")
RESOURCE_FIELDS = (
    "name",
    "file",
    "date_recorded",
    "mime_type",
    "file_width",
    "file_height",
    "file_size",
    "file_fps",
    "file_duration",
)


def resources(media: DataFrame, extensions: Iterable[str] = schema.MEDIA_EXTENSIONS) -> DataFrame:
    """Files to package, by extension."""
    return media.where(filters.in_list(naming.extension(F.col("name")), extensions))


# --- next-fit packing ---


def _next_part(sizes: np.ndarray, limit: int) -> np.ndarray:
    """For a part opened at each file, the place of the file that opens the next one."""
    totals = np.concatenate([[0], np.cumsum(sizes)])
    reach = np.searchsorted(totals, totals[:-1] + limit, side="right") - 1
    return np.maximum(reach, np.arange(1, len(totals)))


def _leave(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts that follow one opened at each place lead out of the places, and how many they are.

    Steps are composed with themselves, so the turns grow with the logarithm of the parts.
    """
    at, parts = following.copy(), np.ones(len(following), dtype=np.int64)
    inside = np.flatnonzero(at < len(at))
    while len(inside):
        reached = at[inside]
        parts[inside] += parts[reached]
        at[inside] = at[reached]
        inside = inside[at[inside] < len(at)]
    return at, parts


def _opened(following: np.ndarray, first: int) -> np.ndarray:
    """1 at the places that open a part, if one is opened at ``first``."""
    end = len(following)
    opens = np.zeros(end + 1, dtype=np.int64)
    opens[first] = 1
    steps = np.append(np.minimum(following, end), end)
    while True:
        reached = steps[np.flatnonzero(opens)]
        if opens[reached].all():
            return opens[:-1]
        opens[reached] = 1
        steps = steps[steps]


def pack_parts(
    files: DataFrame, max_bytes: int | None, *, chunk_rows: int | None = None
) -> DataFrame:
    """Number the parts of every deployment: files in name order, a part ends before it would exceed
    ``max_bytes``. A larger file is a part of its own; without a limit there is one part.

    files: (collection, deployment, name, size), names unique in a deployment; a null size is 0. Each part
    depends on where the one before it ended, so one deployment is followed in order. With ``chunk_rows`` no
    task holds more than about that many files of a deployment, see :func:`_pack_chunks`.
    """
    size = F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size")
    narrow = files.select(*_DEPLOYMENT, "name", size)
    if not max_bytes:
        return narrow.withColumn("part", F.lit(1).cast("bigint"))
    if chunk_rows is not None:
        return _pack_chunks(narrow, max_bytes, chunk_rows)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name", kind="stable")
        following = _next_part(pdf["size"].to_numpy(dtype=np.int64), max_bytes)
        return pdf.assign(part=np.cumsum(_opened(following, 0)))

    return narrow.groupBy(*_DEPLOYMENT).applyInPandas(assign, _PACKED)


_PACKED = "collection string, deployment string, name string, size bigint, part bigint"


def _part_steps(files: DataFrame, limit: int, chunk_rows: int) -> DataFrame:
    """Files with their place, their chunk, the number of files, and ``next``: the place that opens the next
    part if one is opened here. All are read off orders cut into chunks, whatever a part holds."""
    rows = ordered_rows(files, _DEPLOYMENT, ["name"], chunk_rows=chunk_rows)
    placed = rows.extend(position="place", total="files", running={"_bytes": F.col("size")}).result()
    placed = stored(placed, "placed")
    # A file lies at its own total, and asks how many files end within the limit behind its start.
    lies = F.struct(F.col("_bytes").alias("at"), F.lit(0).alias("asks"))
    asks = F.struct((F.col("_bytes") - F.col("size") + F.lit(limit)).alias("at"), F.lit(1).alias("asks"))
    both = placed.select(*_DEPLOYMENT, "place", F.inline(F.array(lies, asks)))
    merged = ordered_rows(both, _DEPLOYMENT, ["at", "asks", "place"], chunk_rows=chunk_rows)
    answered = merged.extend(running={"_within": F.lit(1) - F.col("asks")}).result().where("asks = 1")
    following = answered.select(*_DEPLOYMENT, "place", (F.greatest("place", "_within") + 1).alias("next"))
    chunk = F.expr(f"(place - 1) div {chunk_rows}").alias("chunk")
    return placed.drop("_bytes").join(following, [*_DEPLOYMENT, "place"]).select("*", chunk)


def _chunk_starts(steps: DataFrame, chunk_rows: int) -> DataFrame:
    """Per chunk of the deployments that have several: ``first``, the place that opens the first part in it (null
    if none does), and ``parts``, how many were opened before the chunk."""

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        base = int(pdf["place"].iloc[0])
        at, parts = _leave(pdf["next"].to_numpy(dtype=np.int64) - base)
        return pdf.assign(to=at + base, parts=parts)[[*_DEPLOYMENT, "files", "place", "to", "parts"]]

    several = steps.where(F.col("files") > chunk_rows)
    schema = "collection string, deployment string, files bigint, place bigint, to bigint, parts bigint"
    moves = several.groupBy(*_DEPLOYMENT, "chunk").applyInPandas(leave, schema)
    # Only what a part from another chunk leads to can be the first one opened in a chunk.
    outside = several.where(F.expr(f"(next - 1) div {chunk_rows} > chunk")).select(*_DEPLOYMENT, F.col("next").alias("place"))
    first = F.col("place") == 1
    moves = stored(moves, "part-moves")
    kept = moves.where(first).unionByName(moves.where(~first).join(outside.distinct(), [*_DEPLOYMENT, "place"], "left_semi"))
    moves = stored(kept, "chunk-moves")

    reached = moves.where(first).select(*_DEPLOYMENT, "place", F.lit(0).cast("bigint").alias("before"))
    jumps = moves.where("to <= files").drop("files")
    while not jumps.isEmpty():
        led = reached.join(jumps, [*_DEPLOYMENT, "place"])
        more = led.select(*_DEPLOYMENT, F.col("to").alias("place"), (F.col("before") + F.col("parts")).alias("before"))
        reached = stored(reached.unionByName(more), "reached")
        then = jumps.select(*_DEPLOYMENT, F.col("place").alias("to"), F.col("to").alias("_to"), F.col("parts").alias("_parts"))
        jumps = stored(
            jumps.join(then, [*_DEPLOYMENT, "to"]).select(*_DEPLOYMENT, "place", F.col("_to").alias("to"), (F.col("parts") + F.col("_parts")).alias("parts")),
            "jumps",
        )
    # One row per chunk that has a first place; the chunks up to the next of them lie in one part.
    chunk = F.expr(f"(place - 1) div {chunk_rows}").alias("chunk")
    known = reached.join(moves.select(*_DEPLOYMENT, "place", "files", "parts"), [*_DEPLOYMENT, "place"]).select("*", chunk)
    following = F.lead("chunk").over(Window.partitionBy(*_DEPLOYMENT).orderBy("chunk"))
    until = F.coalesce(following, F.expr(f"(files - 1) div {chunk_rows} + 1"))
    spans = known.withColumn("_last", until - 1).withColumn("_chunk", F.explode(F.sequence("chunk", "_last")))
    own = F.col("_chunk") == F.col("chunk")
    return spans.select(
        *_DEPLOYMENT,
        F.col("_chunk").alias("chunk"),
        F.when(own, F.col("place")).alias("first"),
        (F.col("before") + F.when(own, 0).otherwise(F.col("parts"))).alias("parts"),
    )


def _pack_chunks(files: DataFrame, limit: int, chunk_rows: int) -> DataFrame:
    """Packing with at most ``chunk_rows`` files of a deployment in a task, however much a part holds.

    Which file opens the next part is known for a part opened at any file. Per chunk these steps are composed
    to where its parts lead out of it, and kept only where a part from outside can lead in. The steps out of
    chunks are composed with themselves, two, four, eight chunks at a time, while the files that really open
    the first part in a chunk are followed: as many joins as the number of chunks has binary digits, and no
    task follows a deployment. Then chunks are numbered independently.
    """
    steps = stored(_part_steps(files, limit, chunk_rows), "part-steps")
    starts = _chunk_starts(steps, chunk_rows)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        base = int(pdf["place"].iloc[0])
        first, before = pdf["first"].iloc[0], pdf["parts"].iloc[0]
        opens = np.zeros(len(pdf), dtype=np.int64)
        if not pd.isna(first):
            opens = _opened(pdf["next"].to_numpy(dtype=np.int64) - base, int(first) - base)
        return pdf.assign(part=int(before) + np.cumsum(opens))[[*_DEPLOYMENT, "name", "size", "part"]]

    keys = [*_DEPLOYMENT, "chunk"]
    single = F.col("files") <= chunk_rows
    whole = steps.where(single).withColumns({"first": F.lit(1).cast("bigint"), "parts": F.lit(0).cast("bigint")})
    cut = steps.where(~single).join(starts, keys)
    return whole.unionByName(cut).groupBy(*keys).applyInPandas(assign, _PACKED)


# --- manifests ---


def part_resources(all_resources: DataFrame, parts: DataFrame) -> DataFrame:
    """Resources with the part they belong to; what no part holds is left out."""
    keys = [*_DEPLOYMENT, "name"]
    return all_resources.join(parts.select(*keys, "part"), keys)


def package_stem(name: str, project_id: int, stamp: str) -> Column:
    return naming.package_name(
        F.lit(name), F.lit(project_id), F.lit(stamp), F.col("collection"), F.col("deployment"), F.col("part")
    )


def manifests(
    packed: DataFrame, *, sizes: DataFrame | None = None, page_rows: int = 10_000,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Nested manifest documents: one row per part and page with its resources sorted by name.

    A page holds up to ``page_rows`` resources, so one document never collects an unbounded part; all
    resources are kept, further ones go to further pages. Pass the unpacked files as ``sizes``, so that
    counting the rows does not pack them first.
    """
    group = [*_DEPLOYMENT, "part"]
    present = [c for c in RESOURCE_FIELDS if c in packed.columns]
    rows = ordered_rows(packed.select(*group, *present), group, ["name"], sizes=sizes, chunk_rows=chunk_rows)
    placed = rows.extend(position="_position").result()
    page = F.floor((F.col("_position") - 1) / page_rows) + 1
    return (
        placed.withColumn("page", page)
        .groupBy(*group, "page")
        .agg(F.sort_array(F.collect_list(F.struct(*present))).alias("resources"))
    )


def manifest_totals(packed: DataFrame) -> DataFrame:
    """Files and bytes of every part."""
    return packed.groupBy(*_DEPLOYMENT, "part").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("total_bytes")
    )


def build_packages(
    media: DataFrame,
    *,
    max_bytes: int | None,
    name: str = "package",
    project_id: int,
    stamp: str,
    extensions: Iterable[str] = schema.MEDIA_EXTENSIONS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Every file to package with its part and the stem of the part's package files."""
    wanted = resources(media, extensions)
    parts = pack_parts(
        wanted.select(*_DEPLOYMENT, "name", F.col("file_size").alias("size")), max_bytes, chunk_rows=chunk_rows
    )
    return part_resources(wanted, parts).withColumn("package", package_stem(name, project_id, stamp))


# --- package files and transfer ---


def parsed_packages(listing: DataFrame, collections: DataFrame) -> DataFrame:
    """Package files of known collections: file_name, bytes, collection, deployment, stamp, part, suffix.

    Every beginning of the tail that ends before an underscore is looked up in ``collections``
    (collection), and the longest one known wins, so names with underscores are told apart by a hash join.
    """
    fields = naming.package_fields(F.col("file_name"))
    parsed = listing.select("file_name", "bytes", *[v.alias(k) for k, v in fields.items()]).where("suffix IS NOT NULL")
    words = F.split("tail", "_")
    beginnings = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), "_")
    )
    several = parsed.where(F.size(words) > 1).withColumn("collection", F.explode(beginnings))
    known = several.join(collections.select("collection").distinct(), "collection")
    longest = known.groupBy("file_name", "bytes", "stamp", "tail", "part", "suffix").agg(
        F.max_by("collection", F.length("collection")).alias("collection")
    )
    deployment = F.expr("substring(tail, length(collection) + 2)")
    return longest.select("file_name", "bytes", "collection", deployment.alias("deployment"), "stamp", "part", "suffix")


def package_pairs(listing: DataFrame, collections: DataFrame, deployments: Iterable[str] | None = None) -> DataFrame:
    """Parts for which both package files exist, from (file_name, bytes) and the known collections.

    Files belong together when collection, deployment, stamp and part are the same.
    """
    wanted = parsed_packages(listing, collections).where(filters.in_list(F.col("deployment"), deployments))

    def of(suffix: str, column: str) -> Column:
        return F.max(F.when(F.col("suffix") == suffix, F.col(column)))

    pairs = wanted.groupBy("collection", "deployment", "stamp", "part").agg(
        of(".yaml", "file_name").alias("yaml_file"),
        of(".zip", "file_name").alias("zip_file"),
        (of(".yaml", "bytes") + of(".zip", "bytes")).alias("total_bytes"),
    )
    return pairs.where("yaml_file IS NOT NULL AND zip_file IS NOT NULL")


def chunk_plan(files: DataFrame, chunk_bytes: int = schema.CHUNK_BYTES) -> DataFrame:
    """One row per chunk to transfer: index, offset and length, from (file, remote, size)."""
    count = F.ceil(F.col("size") / chunk_bytes)
    indexes = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))
    chunks = files.withColumn("chunk_index", F.explode(indexes))
    offset = F.col("chunk_index") * chunk_bytes
    return chunks.withColumns(
        {"offset": offset, "chunk_len": F.least(F.lit(chunk_bytes).cast("bigint"), F.col("size") - offset)}
    )


def pending(work: DataFrame, done: DataFrame, keys: Iterable[str], *, within: str | None = None) -> DataFrame:
    """Work that the ledger does not hold.

    ``within`` names a whole-number key, as of a file's chunks. What is held is then gathered as bits, 64 neighbouring
    values of it in a number, and joined by the other keys: ledger rows are combined before they are shuffled, and work
    that is dealt out by the other keys already is not shuffled. A key with a null is never held.
    """
    keys = list(keys)
    if within is None:
        return work.join(done.select(keys), keys, "left_anti")
    others = [key for key in keys if key != within]
    number = F.col(within).cast("bigint")
    bit = F.pmod(number, F.lit(64)).cast("int")
    held = done.where(F.col(within).isNotNull()).select(*others, (number - bit).alias("_base"), bit.alias("_bit"))
    words = held.groupBy(*others, "_base").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_word"))
    bits = words.groupBy(*others).agg(F.map_from_entries(F.collect_list(F.struct("_base", "_word"))).alias("_held"))
    found = work.join(bits, others, "left").withColumn("_word", F.try_element_at("_held", number - bit)).withColumn("_bit", bit)
    is_held = F.expr("shiftright(_word, _bit) & 1 = 1")
    return found.where(~F.coalesce(is_held, F.lit(False))).select(*keys, *[c for c in work.columns if c not in keys])


def ledger_status(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: chunks and bytes done, and whether the ledger still fits the file.

    It fits when the target is the same and its chunks add up to the file's size.
    """
    done = F.col("completed")
    held = ledger.groupBy("file", "remote").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(done).alias("done_chunks"),
        F.coalesce(F.sum(F.when(done, F.col("chunk_len"))), F.lit(0)).alias("done_bytes"),
        F.sum("chunk_len").alias("_ledger_bytes"),
    )
    current = files.select("file", F.col("remote").alias("_target"), "size")
    return held.join(current, "file").select(
        "file",
        "total_chunks",
        "done_chunks",
        "done_bytes",
        ((F.col("remote") == F.col("_target")) & (F.col("_ledger_bytes") == F.col("size"))).alias("is_valid"),
    )
