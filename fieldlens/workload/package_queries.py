"""Queries on packaging and transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import naming
from fieldlens.operators import packaging as P
from fieldlens.workload.registry import SQL_VIEWS, query

LIMIT = 20_000
CHUNK = 10_000_000

SQL_VIEWS["packable"] = "SELECT * FROM files WHERE name NOT LIKE '%.txt'"
SQL_VIEWS["file_places"] = """SELECT collection, deployment, name, file_size AS size,
    row_number() OVER (PARTITION BY collection, deployment ORDER BY name) AS rn FROM packable"""
SQL_VIEWS["recurse_parts"] = f"""SELECT collection, deployment, name, size, rn, 1 AS part, size AS used FROM file_places WHERE rn = 1
    UNION ALL SELECT f.collection, f.deployment, f.name, f.size, f.rn,
      CASE WHEN p.used + f.size > {LIMIT} THEN p.part + 1 ELSE p.part END,
      CASE WHEN p.used + f.size > {LIMIT} THEN f.size ELSE p.used + f.size END
    FROM recurse_parts p JOIN file_places f ON f.collection = p.collection AND f.deployment = p.deployment AND f.rn = p.rn + 1"""
SQL_VIEWS["packed"] = """SELECT f.*, p.part FROM packable f JOIN recurse_parts p
    ON f.collection = p.collection AND f.deployment = p.deployment AND f.name = p.name"""
_STEM = "'package_7_20240101000000_' || collection || '_' || deployment || printf('_part%03d', part)"


def _sizes(t):
    rows = P.resources(t.files)
    return rows.select("collection", "deployment", "name", F.col("file_size").alias("size"))


def _packed(t):
    return P.build_packages(t.files, max_bytes=LIMIT, project_id=7, stamp="20240101000000")


@query("w9_next_fit_parts", "SELECT collection, deployment, name, size, CAST(part AS bigint) AS part FROM recurse_parts")
def _(t):
    return P.pack_parts(_sizes(t), LIMIT)


@query(
    "w9_single_part",
    "SELECT collection, deployment, name, file_size AS size, CAST(1 AS bigint) AS part FROM packable",
)
def _(t):
    return P.pack_parts(_sizes(t), None)


@query(
    "p4_build_packages",
    f"SELECT collection, deployment, name, file_size, CAST(part AS bigint) AS part, {_STEM} AS package FROM packed",
)
def _(t):
    return _packed(t).select("collection", "deployment", "name", "file_size", "part", "package")


@query(
    "j10_part_resources",
    "SELECT collection, deployment, name, mime_type, file_width, CAST(part AS bigint) AS part FROM packed",
)
def _(t):
    parts = P.pack_parts(_sizes(t), LIMIT)
    return P.part_resources(t.files, parts).select("collection", "deployment", "name", "mime_type", "file_width", "part")


@query(
    "a18_package_totals",
    """SELECT collection, deployment, CAST(part AS bigint) AS part, count(*) AS n_files, CAST(sum(file_size) AS bigint) AS total_bytes
       FROM packed GROUP BY collection, deployment, part""",
)
def _(t):
    return P.manifest_totals(_packed(t))


@query(
    "a19_nested_manifest",
    """SELECT collection, deployment, CAST(part AS bigint) AS part, row_number() OVER
         (PARTITION BY collection, deployment, part ORDER BY name) AS place, name, file_size FROM packed""",
)
def _(t):
    documents = P.manifests(_packed(t), sizes=t.files, page_rows=3)
    opened = documents.select("collection", "deployment", "part", "page", F.posexplode("resources").alias("i", "r"))
    place = (F.col("page") - 1) * 3 + F.col("i") + 1
    return opened.select("collection", "deployment", "part", place.alias("place"), "r.name", "r.file_size")


@query(
    "o7_resources_by_name",
    """SELECT collection, deployment, name, row_number() OVER (PARTITION BY collection, deployment ORDER BY name) AS place
       FROM packable""",
)
def _(t):
    from fieldlens.plans.ordered import ordered_rows

    rows = ordered_rows(_sizes(t), ["collection", "deployment"], ["name"]).extend(position="place")
    return rows.result().select("collection", "deployment", "name", "place")


_FORM = "'^[^_]*_[^_]*_([^_]*)_(R[0-9]+|R_[a-z]+)_(.*)_part(.*?)(\\.yaml|\\.zip)$'"
_STAMPS = ("20240101000000", "20250101000000")
# The listing of two runs of the packaging, with all its collections.
SQL_VIEWS["built_packages"] = " UNION ALL ".join(
    f"""SELECT 'package_7_{stamp}_' || collection || '_' || deployment || printf('_part%03d', part) || suffix AS file_name,
      CAST(total AS bigint) AS bytes FROM (SELECT collection, deployment, part, sum(file_size) AS total FROM packed
      GROUP BY collection, deployment, part) p, (VALUES ('.yaml'), ('.zip')) s(suffix)"""
    for stamp in _STAMPS
)


def _parsed(view):
    return f"""SELECT file_name, bytes, regexp_extract(file_name, {_FORM}, 1) AS stamp, regexp_extract(file_name, {_FORM}, 2) AS collection,
    regexp_extract(file_name, {_FORM}, 3) AS deployment, regexp_extract(file_name, {_FORM}, 4) AS part,
    regexp_extract(file_name, {_FORM}, 5) AS suffix FROM {view} WHERE regexp_matches(file_name, {_FORM})"""


def _paired(view):
    return f"""SELECT collection, deployment, stamp, part, max(CASE WHEN suffix = '.yaml' THEN file_name END) AS yaml_file,
      max(CASE WHEN suffix = '.zip' THEN file_name END) AS zip_file,
      max(CASE WHEN suffix = '.yaml' THEN bytes END) + max(CASE WHEN suffix = '.zip' THEN bytes END) AS total_bytes
    FROM ({_parsed(view)}) f GROUP BY collection, deployment, stamp, part HAVING yaml_file IS NOT NULL AND zip_file IS NOT NULL"""


SQL_VIEWS["parsed_packages"] = _parsed("packages")
SQL_VIEWS["pairs"] = _paired("packages")


def _collections(t):
    """Those of the packages, and shorter ones that their names begin with."""
    return t.files.select("collection").unionAll(t.nation.selectExpr("CASE WHEN n_nationkey = 0 THEN 'R0001' ELSE 'R' END"))


def _built(t):
    """File names and sizes as two runs of the packaging leave them."""
    runs = [
        P.manifest_totals(P.build_packages(t.files, max_bytes=LIMIT, project_id=7, stamp=stamp)).withColumn(
            "stem", P.package_stem("package", 7, stamp)
        )
        for stamp in _STAMPS
    ]
    suffixes = F.explode(F.array(F.lit(".yaml"), F.lit(".zip")))
    both = runs[0].unionAll(runs[1]).select("stem", suffixes.alias("suffix"), "total_bytes")
    return both.select(F.concat("stem", "suffix").alias("file_name"), F.col("total_bytes").alias("bytes"))


@query(
    "t16_package_names",
    """SELECT file_name, collection, deployment, part, suffix, 'package_7_20240101000000_' || collection || '_' || deployment || '_part' || part AS stem
       FROM parsed_packages""",
)
def _(t):
    parsed = P.parsed_packages(t.packages, _collections(t))
    stem = naming.package_name(
        F.lit("package"), F.lit(7), F.lit("20240101000000"), F.col("collection"), F.col("deployment"), F.col("part").cast("int")
    )
    return parsed.select("file_name", "collection", "deployment", "part", "suffix", stem.alias("stem"))


@query("t16_built_names", f"SELECT file_name, collection, deployment, stamp, part, suffix FROM ({_parsed('built_packages')}) p")
def _(t):
    return P.parsed_packages(_built(t), _collections(t)).drop("bytes")


@query(
    "s12_package_listing",
    "SELECT file_name, bytes FROM packages WHERE file_name LIKE '%.yaml' OR file_name LIKE '%.zip'",
)
def _(t):
    from fieldlens.sources.tables import package_listing

    return package_listing(t.packages.selectExpr("'/out/R0001/' || file_name AS path", "bytes AS size"))


@query(
    "j9_package_pairs",
    "SELECT * FROM pairs",
)
def _(t):
    return P.package_pairs(t.packages, _collections(t))


@query("j9_built_pairs", f"SELECT * FROM ({_paired('built_packages')}) p")
def _(t):
    return P.package_pairs(_built(t), _collections(t))


@query(
    "t27_transfer_chunks",
    f"""SELECT file, i AS chunk_index, i * {CHUNK} AS "offset", least({CHUNK}, size - i * {CHUNK}) AS chunk_len
       FROM (SELECT file, size, unnest(range(CAST(ceil(size / {CHUNK}) AS bigint))) AS i FROM transfers) c""",
)
def _(t):
    return P.chunk_plan(t.transfers, CHUNK).select("file", "chunk_index", "offset", "chunk_len")


SQL_VIEWS["chunk_ledger"] = f"""SELECT file, remote, size, i AS chunk_index, least({CHUNK}, size - i * {CHUNK}) AS chunk_len,
      (size + i) % 4 <> 0 AS completed
    FROM (SELECT file, remote, size, unnest(range(CAST(ceil(size / {CHUNK}) AS bigint))) AS i FROM transfers) c"""


def _ledger(t, transfers=None):
    return P.chunk_plan(transfers or t.transfers, CHUNK).withColumn("completed", F.expr("(size + chunk_index) % 4 <> 0"))


@query(
    "t27_ledger_status",
    """SELECT l.file, count(*) AS total_chunks, count(*) FILTER (completed) AS done_chunks,
         CAST(coalesce(sum(chunk_len) FILTER (completed), 0) AS bigint) AS done_bytes,
         any_value(l.remote = t.remote) AND sum(chunk_len) = any_value(t.size) AS is_valid
       FROM chunk_ledger l JOIN (SELECT file, CASE WHEN size % 10 = 0 THEN '/elsewhere' ELSE remote END AS remote,
         size + CASE WHEN size % 7 = 0 THEN 1 ELSE 0 END AS size FROM transfers) t ON l.file = t.file GROUP BY l.file""",
)
def _(t):
    current = t.transfers.selectExpr(
        "file", "CASE WHEN size % 10 = 0 THEN '/elsewhere' ELSE remote END AS remote",
        "size + CASE WHEN size % 7 = 0 THEN 1 ELSE 0 END AS size",
    )
    return P.ledger_status(_ledger(t), current)


@query("j11_pending_chunks", "SELECT file, chunk_index FROM chunk_ledger WHERE NOT completed")
def _(t):
    # Files are dealt out before they are cut into chunks, so no chunk is shuffled.
    files = t.transfers.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "file")
    done = _ledger(t, files).where("completed")
    plan = P.chunk_plan(files, CHUNK)
    return P.pending(plan, done, ["file", "chunk_index"], within="chunk_index").select("file", "chunk_index")


@query(
    "p5_transfer_plan",
    """SELECT collection, deployment, stamp, part, yaml_file, zip_file, total_bytes, i AS chunk_index, least(1000, total_bytes - i * 1000) AS chunk_len
       FROM (SELECT *, unnest(range(CAST(ceil(total_bytes / 1000) AS bigint))) AS i FROM pairs) c""",
)
def _(t):
    pairs = P.package_pairs(t.packages, _collections(t)).withColumn("size", F.col("total_bytes"))
    return P.chunk_plan(pairs, 1000).drop("size", "offset")


@query(
    "p5_built_transfer",
    f"""SELECT yaml_file, i AS chunk_index, least(10000, total_bytes - i * 10000) AS chunk_len
       FROM (SELECT *, unnest(range(CAST(ceil(total_bytes / 10000) AS bigint))) AS i FROM ({_paired('built_packages')}) p) c""",
)
def _(t):
    pairs = P.package_pairs(_built(t), _collections(t)).withColumn("size", F.col("total_bytes"))
    return P.chunk_plan(pairs, 10_000).select("yaml_file", "chunk_index", "chunk_len")
