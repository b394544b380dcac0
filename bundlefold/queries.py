"""The engine's registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import PackConfig
from .functions import codecs
from .functions import columns as C
from .operators import frames as frame_ops
from .operators import paths as path_ops
from .operators import planner
from .operators.numbering import with_entry_ids, with_hardlinks
from .plans import pack as pack_plan
from .plans import report, unpack, workload
from .schemas import BUNDLE_KIND, DATA_CODEC, ENTRY_FLAGS, EXTENT_FLAGS, FEATURE_FLAGS, INTEGRITY_MODE
from .sources import layout
from .sources.virtual import document_tree, order_tree, place_tree
from .tables import keep

TARGET, THRESHOLD = 65536, 8192
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d, text=False) -> DataFrame:
    return with_hardlinks(with_entry_ids(document_tree(table(spark, d, "documents"), text)))


def _orders(spark, d) -> DataFrame:
    return with_hardlinks(with_entry_ids(order_tree(table(spark, d, "orders"), table(spark, d, "lineitem"))))


def _path(c: str = "relative_path"):
    return F.when(F.octet_length(c) == 0, ".").otherwise(C.lossy_utf8(c))


# -- the trees in SQL ------------------------------------------------------------------------------------------------

_TREE = """
leaves AS ({leaves}),
folders AS (SELECT DISTINCT list_slice(c, 1, k) AS c FROM (SELECT c, unnest(range(0, len(c))) AS k FROM leaves)),
nodes AS (SELECT c, 'regular' AS kind, size, ino, id FROM leaves UNION ALL SELECT c, CASE WHEN len(c) = 0 THEN 'root' ELSE 'directory' END, 0, NULL, NULL FROM folders),
numbered AS (SELECT row_number() OVER (ORDER BY c) - 1 AS entry_id, c, kind, size, ino, id, coalesce(c[-1], '') AS name FROM nodes),
tree AS (SELECT n.entry_id, p.entry_id AS parent_id, n.c, n.kind, n.size, n.id, n.name,
           CASE WHEN n.kind = 'regular' AND m.first < n.entry_id THEN m.first END AS master
         FROM numbered n LEFT JOIN numbered p ON len(n.c) > 0 AND p.c = list_slice(n.c, 1, len(n.c) - 1)
           LEFT JOIN (SELECT ino, min(entry_id) AS first FROM numbered WHERE kind = 'regular' GROUP BY ino) m ON m.ino = n.ino),
told AS (SELECT entry_id, parent_id, CASE WHEN len(c) = 0 THEN '.' ELSE array_to_string(c, '/') END AS path, len(c) AS depth,
           CASE WHEN master IS NOT NULL THEN 'hardlink' ELSE kind END AS kind, size, master, id, name, c FROM tree)
"""
_DOC_LEAVES = "SELECT [coalesce(source, 'none'), coalesce(lang, 'none'), 'doc_' || doc_id] AS c, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, md5(coalesce(text, '')) AS ino, doc_id AS id FROM documents"
_ORDER_LEAVES = (
    "SELECT [CAST(year(o_orderdate) AS VARCHAR), 'order_' || o_orderkey] AS c, CAST(coalesce(n, 0) * 100 AS BIGINT) AS size, CAST(o_orderkey AS VARCHAR) AS ino, o_orderkey AS id "
    "FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) i ON l_orderkey = o_orderkey"
)
_PLACE_LEAVES = (
    "SELECT [r_name, n_name, who] AS c, CAST(strlen(who) AS BIGINT) AS size, who AS ino, 0 AS id FROM (SELECT c_nationkey AS n, c_name AS who FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier) "
    "JOIN nation ON n = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
_DOCS = _TREE.format(leaves=_DOC_LEAVES)
_ORDERS = _TREE.format(leaves=_ORDER_LEAVES)
_PLACES = _TREE.format(leaves=_PLACE_LEAVES)
# the fold of next-fit, a row at a time; b: open bundle, r: bytes in it
_PLAN = f"""
data AS MATERIALIZED (SELECT row_number() OVER (ORDER BY entry_id) AS k, entry_id, size FROM told WHERE kind = 'regular' AND size > 0),
fold AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS entry_id, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS home, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS r
  UNION ALL
  SELECT d.k, d.entry_id, d.size,
    CASE WHEN d.size >= {THRESHOLD} THEN f.b + CASE WHEN f.r > 0 THEN 1 ELSE 0 END WHEN f.r > 0 AND f.r + d.size > {TARGET} THEN f.b + 1 ELSE f.b END,
    CASE WHEN d.size >= {THRESHOLD} OR (f.r > 0 AND f.r + d.size > {TARGET}) THEN 0 ELSE f.r END,
    CASE WHEN d.size >= {THRESHOLD} THEN f.b + CASE WHEN f.r > 0 THEN 1 ELSE 0 END + (d.size + {TARGET} - 1) // {TARGET} WHEN f.r > 0 AND f.r + d.size > {TARGET} THEN f.b + 1 ELSE f.b END,
    CASE WHEN d.size >= {THRESHOLD} THEN 0 WHEN f.r > 0 AND f.r + d.size > {TARGET} THEN d.size ELSE f.r + d.size END
  FROM fold f JOIN data d ON d.k = f.k + 1
),
extents AS (
  SELECT entry_id, home AS bundle_id, CAST(0 AS BIGINT) AS file_offset, off AS raw_offset_in_bundle, size AS raw_len, CAST(3 AS BIGINT) AS flags_bits FROM fold WHERE k > 0 AND size < {THRESHOLD}
  UNION ALL
  SELECT entry_id, home + j, j * {TARGET}, 0, least({TARGET}, size - j * {TARGET}), CASE WHEN (j + 1) * {TARGET} >= size THEN 5 ELSE 4 END
  FROM (SELECT *, unnest(range(0, (size + {TARGET} - 1) // {TARGET})) AS j FROM fold WHERE k > 0 AND size >= {THRESHOLD})
)"""
_B = "CAST({0} AS BIGINT) AS {1}".format


# -- scan, numbers, hard links ---------------------------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT entry_id, parent_id, path, CAST(depth AS INTEGER) AS depth, kind, size FROM told")
def tree_entries(spark, d):
    e = _docs(spark, d)
    return e.select("entry_id", "parent_id", _path().alias("path"), F.size("components").alias("depth"), "kind", "size")


@query(f"WITH {_DOCS} SELECT entry_id, master AS hardlink_master_entry_id FROM told WHERE kind = 'hardlink'")
def hardlink_resolution(spark, d):
    return _docs(spark, d).where("kind = 'hardlink'").select("entry_id", "hardlink_master_entry_id")


@query(f"WITH {_DOCS} SELECT a.path AS link_path, b.path AS master_path, a.size = b.size AS same_size FROM told a JOIN told b ON a.master = b.entry_id")
def hardlink_targets(spark, d):
    e = keep(_docs(spark, d), "entries")
    m = e.select(F.col("entry_id").alias("hardlink_master_entry_id"), _path().alias("master_path"), F.col("size").alias("s"))
    return e.where("kind = 'hardlink'").join(m, "hardlink_master_entry_id").select(_path().alias("link_path"), "master_path", (F.col("size") == F.col("s")).alias("same_size"))


@query(f"WITH {_DOCS} SELECT {_B('count(*)', 'entry_count')}, {_B("count(*) FILTER (kind IN ('regular', 'hardlink'))", 'regular_file_count')}, {_B("count(*) FILTER (kind IN ('root', 'directory'))", 'directory_count')}, {_B("sum(size) FILTER (kind IN ('regular', 'hardlink'))", 'raw_bytes')} FROM told")
def tree_totals(spark, d):
    return pack_plan.tree_totals(document_tree(table(spark, d, "documents")))


@query(f"WITH {_DOCS} SELECT kind, {_B('count(*)', 'entries')}, {_B('sum(size)', 'bytes')} FROM told GROUP BY kind")
def entries_by_kind(spark, d):
    return _docs(spark, d).groupBy("kind").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


@query(f"WITH {_ORDERS} SELECT path, size FROM told WHERE kind = 'regular' AND size = 0")
def empty_files(spark, d):
    """Regular files that no extent belongs to: an anti-join of entries and extents."""
    e = keep(_orders(spark, d), "entries")
    x = planner.extents_of(e, TARGET, 500)
    return e.where("kind = 'regular'").join(x, "entry_id", "left_anti").select(_path().alias("path"), "size")


# -- planning --------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN} SELECT {_B('row_number() OVER (ORDER BY entry_id, file_offset) - 1', 'extent_id')}, entry_id, bundle_id, file_offset, raw_offset_in_bundle, raw_len, flags_bits FROM extents")
def bundle_extents(spark, d):
    return planner.extents_of(_docs(spark, d), TARGET, THRESHOLD)


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN} SELECT bundle_id, CASE WHEN bit_or(flags_bits & 4) <> 0 THEN 'single_file' ELSE 'aggregate' END AS kind, {_B('sum(raw_len)', 'raw_len')}, {_B('count(*)', 'file_count')}, {_B('count(*)', 'extent_count')}, CAST(0 AS INTEGER) AS flags FROM extents GROUP BY bundle_id")
def bundle_summary(spark, d):
    return planner.bundles_of(planner.extents_of(_docs(spark, d), TARGET, THRESHOLD))


@query(f"""WITH RECURSIVE {_DOCS}, {_PLAN}, per AS (SELECT entry_id, count(*) AS n FROM extents GROUP BY entry_id)
SELECT entry_id, parent_id, kind, CAST(CASE WHEN kind = 'regular' AND size = 0 THEN 1 ELSE 0 END AS INTEGER) AS flags_bits, size, {_B('coalesce(sum(strlen(name)) OVER (ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)', 'name_off')},
  {_B('strlen(name)', 'name_len')}, {_B('coalesce(sum(coalesce(n, 0)) OVER (ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)', 'first_extent')}, {_B('coalesce(n, 0)', 'extent_count')}, master AS hardlink_master_entry_id
FROM told LEFT JOIN per USING (entry_id)""")
def manifest_entries(spark, d):
    plan = pack_plan.plan_archive(_docs(spark, d), PackConfig(bundle_target_bytes=TARGET, small_file_threshold=THRESHOLD))
    return plan.entries.select("entry_id", "parent_id", "kind", "flags_bits", "size", "name_off", "name_len", "first_extent", "extent_count", "hardlink_master_entry_id")


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN} SELECT path, bundle_id, file_offset, raw_offset_in_bundle, raw_len FROM extents JOIN told USING (entry_id)")
def extent_paths(spark, d):
    e = keep(_docs(spark, d), "entries")
    return planner.extents_of(e, TARGET, THRESHOLD).join(e, "entry_id").select(_path().alias("path"), "bundle_id", "file_offset", "raw_offset_in_bundle", "raw_len")


@query(f"""WITH RECURSIVE {_DOCS}, {_PLAN} SELECT entry_id, bundle_id, lead(bundle_id) OVER (PARTITION BY entry_id ORDER BY file_offset) IS NULL AS last, (flags_bits & 1) = 1 AS last_flag,
  list_filter([CASE WHEN flags_bits & 1 <> 0 THEN 'last_extent' END, CASE WHEN flags_bits & 2 <> 0 THEN 'aggregate_bundle' END, CASE WHEN flags_bits & 4 <> 0 THEN 'single_file_bundle' END], lambda x: x IS NOT NULL)::VARCHAR AS flags FROM extents""")
def last_extents(spark, d):
    x = planner.extents_of(_docs(spark, d), TARGET, THRESHOLD)
    after = F.lead("bundle_id").over(Window.partitionBy("entry_id").orderBy("file_offset"))
    names = F.concat(F.lit("["), F.array_join(C.flag_names("flags_bits", EXTENT_FLAGS), ", "), F.lit("]"))
    return x.select("entry_id", "bundle_id", after.isNull().alias("last"), (F.col("flags_bits").bitwiseAND(1) == 1).alias("last_flag"), names.alias("flags"))


@query(f"""WITH RECURSIVE {_DOCS}, {_PLAN}, s AS (SELECT *, CASE WHEN lag(entry_id) OVER w <> entry_id THEN 1 ELSE 0 END AS new FROM extents WINDOW w AS (PARTITION BY bundle_id ORDER BY raw_offset_in_bundle, entry_id))
SELECT bundle_id, {_B('count(*)', 'extent_count')}, {_B('count(DISTINCT entry_id)', 'unique_entries')}, {_B('sum(new)', 'entry_switches')} FROM s GROUP BY bundle_id""")
def bundle_shapes(spark, d):
    return planner.extent_sequence(planner.extents_of(_docs(spark, d), TARGET, THRESHOLD))


@query(f"""WITH RECURSIVE {_DOCS}, {_PLAN}, s AS (SELECT bundle_id, count(*) AS x, count(DISTINCT entry_id) AS u FROM extents GROUP BY bundle_id)
SELECT {_B('count(*)', 'bundles_observed')}, {_B('sum(x)', 'total_bundle_extents')}, {_B('sum(u)', 'total_bundle_unique_entries')}, {_B('sum(u - 1)', 'total_bundle_entry_switches')}, {_B('max(x)', 'max_bundle_extent_count')}, {_B('max(u)', 'max_bundle_unique_entries')} FROM s""")
def bundle_diagnostics(spark, d):
    return unpack.bundle_counters(planner.extents_of(_docs(spark, d), TARGET, THRESHOLD))


@query(f"""WITH RECURSIVE {_DOCS}, {_PLAN}, b AS (SELECT bundle_id, sum(raw_len) AS r FROM extents GROUP BY 1)
SELECT bundle_id, {_B('count(*) OVER w', 'frames')}, {_B('sum(r) OVER w', 'raw_so_far')} FROM b WINDOW w AS (ORDER BY bundle_id)""")
def frame_running_totals(spark, d):
    from .tables import in_order

    b = planner.bundles_of(planner.extents_of(_docs(spark, d), TARGET, THRESHOLD))
    t = in_order(b, ["bundle_id"], number="n", sums={"r": F.col("raw_len")})
    return t.select("bundle_id", (F.col("n") + 1).alias("frames"), (F.col("r") + F.col("raw_len")).alias("raw_so_far"))


@query(f"""WITH RECURSIVE {_DOCS}, {_PLAN}, e AS (SELECT count(*) AS n, sum(strlen(name)) AS names, bool_or(kind = 'symlink') AS s, bool_or(kind = 'hardlink') AS h FROM told), x AS (SELECT count(*) AS n, count(DISTINCT bundle_id) AS b FROM extents)
SELECT {_B('e.n', 'entry_count')}, {_B('x.n', 'extent_count')}, {_B('x.b', 'bundle_count')}, {_B('64 + 96 * e.n + 32 * x.n + 32 * x.b + e.names', 'manifest_raw_len')}, {_B('CASE WHEN s THEN 1 ELSE 0 END + CASE WHEN h THEN 2 ELSE 0 END + 16', 'feature_flags_bits')},
  (CASE WHEN h THEN '[has_hardlink, has_trailer]' ELSE '[has_trailer]' END) AS feature_flags, 'zstd' AS data_codec, 'strong' AS integrity_mode FROM e, x""")
def header_fields(spark, d):
    """The header that a plan leads to."""
    plan = pack_plan.plan_archive(_docs(spark, d), PackConfig(bundle_target_bytes=TARGET, small_file_threshold=THRESHOLD, integrity="strong"))
    e = plan.entries.agg(F.count("*").alias("entry_count"), F.sum(F.col("name_len") + F.col("link_len")).alias("names"), planner.feature_bits(plan.entries, True, False).alias("feature_flags_bits"))
    x = plan.extents.agg(F.count("*").alias("extent_count"), F.countDistinct("bundle_id").alias("bundle_count"))
    size = F.lit(layout.MANIFEST_LEN) + F.col("entry_count") * layout.ENTRY.itemsize + F.col("extent_count") * layout.EXTENT.itemsize + F.col("bundle_count") * layout.BUNDLE.itemsize + F.col("names")
    flags = F.concat(F.lit("["), F.array_join(C.flag_names("feature_flags_bits", FEATURE_FLAGS), ", "), F.lit("]"))
    return e.join(x, F.lit(True)).select("entry_count", "extent_count", "bundle_count", size.alias("manifest_raw_len"), "feature_flags_bits", flags.alias("feature_flags"), C.name_of(F.lit(2), DATA_CODEC, "data codec").alias("data_codec"), C.name_of(F.lit(2), INTEGRITY_MODE, "integrity mode").alias("integrity_mode"))  # one row each


@query(f"""WITH RECURSIVE {_DOCS}, {_PLAN}, b AS (SELECT bundle_id, sum(raw_len) AS r FROM extents GROUP BY 1), f AS (SELECT sum(size) AS s, sum(CASE WHEN kind = 'regular' THEN size ELSE 0 END) AS own FROM told WHERE kind IN ('regular', 'hardlink'))
SELECT {_B('sum(r)', 'raw_bytes')}, {_B('count(*)', 'bundle_count')}, {_B(f'sum(r) + 48 * count(*) + 128 + 64', 'none_coded_bytes')}, any_value(own) = sum(r) AS every_byte_once FROM b, f""")
def pack_totals(spark, d):
    """Sums of a plan's bundles, and whether they hold each file's bytes once."""
    e = keep(_docs(spark, d), "entries")
    b = planner.bundles_of(planner.extents_of(e, TARGET, THRESHOLD)).agg(F.sum("raw_len").alias("raw_bytes"), F.count("*").alias("bundle_count"))
    own = e.where(planner.carries_data()).agg(F.sum("size").alias("own"))
    total = F.col("raw_bytes") + layout.FRAME_LEN * F.col("bundle_count") + layout.HEADER_LEN + layout.TRAILER_LEN
    return b.join(own, F.lit(True)).select("raw_bytes", "bundle_count", total.alias("none_coded_bytes"), (F.col("own") == F.col("raw_bytes")).alias("every_byte_once"))  # one row each


@query(f"WITH t AS (SELECT source, sum(strlen(coalesce(text, ''))) AS raw FROM documents GROUP BY source) SELECT source, {_B('raw', 'raw_bytes')}, {_B(f'CASE WHEN raw > 0 THEN ceil(raw / {TARGET}) ELSE 0 END', 'bundles')}, {_B('trunc(raw * 0.72::DOUBLE)', 'lz4_bytes')}, {_B('trunc(raw * 0.58::DOUBLE)', 'zstd_bytes')} FROM t")
def pack_estimates(spark, d):
    t = table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("raw_bytes"))
    return t.select("source", "raw_bytes", C.estimated_bundles("raw_bytes", TARGET).alias("bundles"), C.estimated_encoded("raw_bytes", "lz4").alias("lz4_bytes"), C.estimated_encoded("raw_bytes", "zstd").alias("zstd_bytes"))


# -- paths -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_PLACES} SELECT entry_id, path, CAST(depth AS INTEGER) AS depth FROM told")
def entry_paths(spark, d):
    """Paths from parent ids alone, by joins that double the known ancestors."""
    e = with_entry_ids(place_tree(*(table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))))
    return path_ops.entry_paths(e.select("entry_id", "parent_id", "name")).select("entry_id", "path", "depth")


@query(f"WITH {_PLACES} SELECT entry_id, path, CAST(depth AS INTEGER) AS depth FROM told WHERE kind <> 'regular'")
def folder_paths_recursive(spark, d):
    e = keep(with_entry_ids(place_tree(*(table(spark, d, t) for t in ("region", "nation", "customer", "supplier")))).where("kind <> 'regular'"), "folders")
    return path_ops.entry_paths_sql(e.select("entry_id", "parent_id", "name"))


@query(f"WITH {_DOCS} SELECT CAST(depth AS INTEGER) AS depth, {_B('count(*)', 'directories')} FROM told WHERE kind IN ('root', 'directory') GROUP BY depth")
def directory_frontiers(spark, d):
    e = keep(_docs(spark, d), "entries")
    return path_ops.frontiers(e, e.select("entry_id", F.size("components").alias("depth")))


@query(f"WITH {_DOCS} SELECT entry_id, path, {_B('row_number() OVER (ORDER BY depth DESC, entry_id DESC)', 'place')} FROM told WHERE kind = 'directory'")
def finalize_order(spark, d):
    """Folders deepest first, in the reverse of their ids: the order in which their own times are set."""
    from .tables import in_order

    e = _docs(spark, d).where("kind = 'directory'").select("entry_id", _path().alias("path"), F.size("components").alias("depth"))
    return in_order(e, [F.desc("depth"), F.desc("entry_id")], number="n").select("entry_id", "path", (F.col("n") + 1).alias("place"))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN path WHEN 1 THEN '../' || path WHEN 2 THEN '/' || path WHEN 3 THEN './' || path ELSE path || '/../x' END AS path FROM p)
SELECT page_id, path, CASE WHEN path LIKE '/%' THEN 'absolute path' WHEN list_contains(string_split(path, '/'), '..') THEN 'parent segment' WHEN path LIKE './%' THEN 'current segment' END AS error FROM v""")
def path_safety(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("p"))
    k = F.col("page_id") % 5
    path = F.when(k == 0, F.col("p")).when(k == 1, F.concat(F.lit("../"), "p")).when(k == 2, F.concat(F.lit("/"), "p")).when(k == 3, F.concat(F.lit("./"), "p")).otherwise(F.concat("p", F.lit("/../x")))
    return p.select("page_id", path.alias("path")).withColumn("error", C.path_error("path"))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), s AS (SELECT *, string_split(path, '/') AS c FROM p)
SELECT page_id, '/out/' || path AS target, array_to_string(list_slice(c, 1, len(c) - 1), '/') AS parent, c[-1] AS leaf, CAST(len(c) AS INTEGER) AS depth FROM s""")
def path_split(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("p"))
    return p.select("page_id", C.safe_join("/out/", "p").alias("target"), C.parent_of("p").alias("parent"), C.leaf_of("p").alias("leaf"), F.size(C.components("p")).alias("depth"))


@query("""WITH p AS (SELECT DISTINCT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS c FROM pages)
SELECT DISTINCT array_to_string(list_slice(c, 1, k), '/') AS directory FROM (SELECT c, unnest(range(0, len(c))) AS k FROM p)""")
def distinct_directories(spark, d):
    return path_ops.ancestors(table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")))


# -- frames ----------------------------------------------------------------------------------------------------------


def _frames(spark, d, codec="zstd"):
    e = keep(_docs(spark, d, text=True), "entries")
    x = keep(planner.extents_of(e, TARGET, THRESHOLD), "extents")
    contents = e.where(planner.carries_data()).select("entry_id", F.col("text").cast("binary").alias("content"))
    return e, x, keep(frame_ops.frames_from_contents(x, contents, codec), "frames")


@query(f"WITH {_DOCS} SELECT path, size, sha256(text) AS sha256 FROM told JOIN documents ON id = doc_id WHERE kind = 'regular' AND size > 0")
def round_trip(spark, d):
    """Every file after its bundle was encoded, decoded, checked and cut up."""
    e, x, frames = _frames(spark, d)
    pieces = frame_ops.file_pieces(frame_ops.decoded(frames, "zstd"), x)
    joined = F.expr("aggregate(transform(array_sort(collect_list(struct(file_offset, piece))), s -> s.piece), cast('' as binary), (a, b) -> concat(a, b))")
    files = pieces.groupBy("entry_id").agg(joined.alias("content"))
    return files.join(e, "entry_id").select(_path().alias("path"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN} SELECT bundle_id, {_B('sum(raw_len)', 'raw_len')}, {_B('count(*)', 'extents')}, {_B('min(entry_id)', 'first_entry')} FROM extents GROUP BY bundle_id")
def frames_with_extents(spark, d):
    """Frames with the list of their extents, a left join on the bundle."""
    _, x, frames = _frames(spark, d)
    j = frame_ops.with_extents(frames, x)
    return j.select("bundle_id", "raw_len", F.size("extents").cast("long").alias("extents"), F.array_min(F.col("extents.entry_id")).alias("first_entry"))


@query(f"""WITH RECURSIVE {_DOCS}, {_PLAN}, t AS (SELECT {_B('count(DISTINCT bundle_id)', 'bundle_count')}, {_B('sum(raw_len)', 'total_raw_bytes')} FROM extents)
SELECT change, bundle_count, total_raw_bytes, change = 'none' AS matches FROM t, (VALUES ('none'), ('one hash'), ('two swapped'), ('one frame less'), ('raw bytes'), ('encoded bytes')) c(change)""")
def trailer_check(spark, d):
    """The trailer that a container holds, against its frames as they are and changed in several ways."""
    from .sources.container import read_container

    path = _container(spark, d, integrity="strong")
    frames, trailer = keep(read_container(spark, path, "frames").select("bundle_id", "raw_len", "encoded_len", "frame_hash"), "frames"), read_container(spark, path, "trailer").first().asDict()
    last = F.col("bundle_id") == trailer["bundle_count"] - 1
    swapped = F.when(F.col("bundle_id") < 2, 1 - F.col("bundle_id")).otherwise(F.col("bundle_id"))
    changed = {
        "none": (frames, trailer), "one hash": (frames.withColumn("frame_hash", F.when(last, F.col("frame_hash").bitwiseXOR(1)).otherwise(F.col("frame_hash"))), trailer),
        "two swapped": (frames.withColumn("bundle_id", swapped), trailer), "one frame less": (frames.where(~last), trailer),
        "raw bytes": (frames, trailer | {"total_raw_bytes": trailer["total_raw_bytes"] + 1}), "encoded bytes": (frames, trailer | {"total_encoded_bytes": trailer["total_encoded_bytes"] - 1}),
    }
    rows = [(name, trailer["bundle_count"], trailer["total_raw_bytes"], frame_ops.trailer_matches(f, t)) for name, (f, t) in changed.items()]
    return spark.createDataFrame(rows, "change string, bundle_count long, total_raw_bytes long, matches boolean")


@query()
def frame_hashes(spark, d):
    """XXH3-64 of each text, which SQL has no function for."""
    return table(spark, d, "documents").select("doc_id", codecs.hash_hex(codecs.xxh3_64(F.col("text").cast("binary"))).alias("xxh3_64"), F.lower(F.hex(codecs.blake3_256(F.col("text").cast("binary")))).alias("blake3_256"))


# -- scalar functions ------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, replace(replace(replace(p_name, '@', ''), '/', '-'), '.', '-') AS safe, lower(hex(p_brand)) AS brand_hex, '0o' || printf('%o', 32768 + p_size) AS mode,
  CASE WHEN regexp_full_match(p_type, '[A-Za-z0-9/._:-]+') THEN p_type ELSE '''' || replace(p_type, '''', '''"''"''') || '''' END AS word FROM part""")
def name_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", C.safe_name("p_name").alias("safe"), C.hex_lower(F.col("p_brand").cast("binary")).alias("brand_hex"), C.octal_mode(F.col("p_size") + 32768).alias("mode"), C.shell_word("p_type").alias("word"))


@query("SELECT n_nationkey, CASE n_regionkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'lz4' ELSE 'zstd' END AS codec, CASE n_nationkey % 2 WHEN 0 THEN 'aggregate' ELSE 'single_file' END AS bundle_kind, CAST(n_nationkey % 2 AS INTEGER) AS kind_code, replace('[' || array_to_string(list_filter([CASE WHEN n_nationkey & 1 <> 0 THEN 'empty_file' END, CASE WHEN n_nationkey & 2 <> 0 THEN 'path_validated' END, CASE WHEN n_nationkey & 4 <> 0 THEN 'has_metadata' END], lambda x: x IS NOT NULL), ', ') || ']', '  ', ' ') AS flags FROM nation")
def enum_codes(spark, d):
    n = table(spark, d, "nation")
    kind = C.name_of(F.col("n_nationkey") % 2, BUNDLE_KIND, "bundle kind")
    flags = F.concat(F.lit("["), F.array_join(C.flag_names("n_nationkey", ENTRY_FLAGS), ", "), F.lit("]"))
    return n.select("n_nationkey", C.name_of(F.col("n_regionkey") % 3, DATA_CODEC, "data codec").alias("codec"), kind.alias("bundle_kind"), C.code_of(kind, BUNDLE_KIND, "bundle kind").alias("kind_code"), flags.alias("flags"))


@query("WITH e AS (SELECT user_id, event_id AS total, CAST(floor(value) AS BIGINT) AS setup, user_id AS pipeline FROM events) SELECT total, setup, pipeline, least(setup, total) AS setup_ms, least(pipeline, total - least(setup, total)) AS pipeline_ms, total - least(setup, total) - least(pipeline, total - least(setup, total)) AS finalize_ms FROM e")
def wall_buckets(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("total"), F.floor("value").alias("setup"), F.col("user_id").alias("pipeline"))
    return e.select("*", *[c.alias(k) for k, c in C.wall_buckets("total", "setup", "pipeline").items()])


@query("WITH e AS (SELECT user_id, count(*) AS files, sum(event_id) AS bytes, count(*) % 3 * 10 AS ms FROM events GROUP BY user_id) SELECT user_id, files, CASE WHEN ms > 0 THEN files / (ms / 1000.0) ELSE 0 END::DOUBLE AS files_per_second, CASE WHEN ms > 0 THEN (bytes / 1048576.0) / (ms / 1000.0) END::DOUBLE AS mib_per_sec FROM e")
def run_rates(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("files"), F.sum("event_id").alias("bytes")).withColumn("ms", F.col("files") % 3 * 10)
    return e.select("user_id", "files", C.per_second("files", "ms").alias("files_per_second"), C.per_second(C.mib("bytes"), "ms", None).alias("mib_per_sec"))


@query("SELECT event_type, least(sum((event_id % 100)::HUGEINT * 1000000000000000), 9223372036854775807)::BIGINT AS total FROM events GROUP BY event_type")
def saturating_totals(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(C.saturating_sum(F.col("event_id") % 100 * F.lit(10**15)).alias("total"))


@query("SELECT c_mktsegment, 'Run' || chr(10) || 'codec: zstd' || chr(10) || 'entry_count: ' || count(*) || chr(10) || 'files_per_second: ' || printf('%.2f', count(*) / 2.0) AS text FROM customer GROUP BY c_mktsegment")
def summary_lines(spark, d):
    t = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    parts = [F.lit("Run"), F.lit("codec: zstd"), F.concat(F.lit("entry_count: "), F.col("n").cast("string")), F.format_string("files_per_second: %.2f", C.per_second("n", F.lit(2000)))]
    return t.select("c_mktsegment", F.array_join(F.array(*parts), "\n").alias("text"))


# -- sets, reports, workload -----------------------------------------------------------------------------------------


@query("WITH want AS (SELECT n_nationkey AS k FROM nation), have AS (SELECT DISTINCT s_nationkey + 1 AS k FROM supplier) SELECT k, 'missing' AS problem FROM (FROM want EXCEPT ALL FROM have) UNION ALL SELECT k, 'extra' FROM (FROM have EXCEPT ALL FROM want)")
def expected_keys(spark, d):
    want = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    have = table(spark, d, "supplier").select((F.col("s_nationkey") + 1).alias("k")).distinct()
    return report.missing_and_extra(have, want, ["k"])


@query("WITH t AS (SELECT l_returnflag AS w, l_linestatus AS p, l_shipdate < DATE '1995-06-01' AS early, count(*) AS ms, sum(l_linenumber) AS b FROM lineitem GROUP BY ALL) SELECT a.w AS workload, a.p AS phase, y.ms / a.ms AS time_ratio, y.b / a.b AS size_ratio FROM t a JOIN t y ON a.w = y.w AND a.p = y.p AND a.early AND NOT y.early")
def baseline_ratios(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("workload"), F.col("l_linestatus").alias("phase"), F.when(F.col("l_shipdate") < F.lit("1995-06-01").cast("date"), "early").otherwise("late").alias("baseline"))
    rows = t.agg(F.count("*").alias("elapsed_ms"), F.sum("l_linenumber").alias("output_size_bytes"))
    return report.ratios(rows, "early", "late")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents) SELECT doc_id, arg_min(line, k) AS line FROM l WHERE trim(line) <> '' GROUP BY doc_id")
def first_lines(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    return t.select("doc_id", F.get(F.filter("l", lambda x: F.trim(x) != ""), F.lit(0)).alias("line")).where("line is not null")


@query("SELECT 'out' AS stream, conv_id, turn, text AS line FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'err', conv_id, turn, text FROM conversations WHERE role <> 'assistant'")
def joined_output(spark, d):
    t = table(spark, d, "conversations")
    pick = lambda name, c: t.where(c).select(F.lit(name).alias("stream"), "conv_id", "turn", F.col("text").alias("line"))
    return pick("out", F.col("role") == "assistant").unionAll(pick("err", F.col("role") != "assistant"))


_SCOPES = ["@types", "@build", "@check"]
_PACKAGES = f"""
pk AS (
  SELECT i AS index, 1 AS depth, CAST(NULL AS BIGINT) AS parent FROM range(64) r(i)
  UNION ALL SELECT 64 + i, 2, i // 4 FROM range(256) r(i)
  UNION ALL SELECT 320 + i, 3, 64 + i // 4 FROM range(1024) r(i)
  UNION ALL SELECT 1344 + i, 4, 320 + i // 3 FROM range(3072) r(i)
  UNION ALL SELECT 4416 + i, 5, 1344 + i // 2 FROM range(6144) r(i)),
nm AS (SELECT index, depth, parent, CASE WHEN (index + 1) % 3 = 0 THEN {_SCOPES}[index % 3 + 1] || '/' ELSE '' END || {list(workload.PACKAGE_WORDS)}[index % 8 + 1] || printf('-%05d', index + 1) AS name FROM pk)"""


@query(f"""WITH RECURSIVE {_PACKAGES}, dirs AS (SELECT index, 'node_modules/' || name AS dir FROM nm WHERE parent IS NULL UNION ALL SELECT n.index, dirs.dir || '/node_modules/' || n.name FROM nm n JOIN dirs ON n.parent = dirs.index),
kids AS (SELECT parent, count(*) AS n, string_agg('- `' || name || '`', chr(10) ORDER BY index) AS list FROM nm WHERE parent IS NOT NULL GROUP BY parent)
SELECT index, CAST(depth AS INTEGER) AS depth, name, dir AS relative_dir, CAST(coalesce(n, 0) AS INTEGER) AS dependencies, name || ' 1.' || (index % 9 + 1) || '.0' || chr(10) || coalesce(list, '- (leaf package)') AS readme FROM nm JOIN dirs USING (index) LEFT JOIN kids ON kids.parent = nm.index""")
def workload_packages(spark, d):
    p = workload.packages(spark, 64, [4, 4, 3, 2], 3, _SCOPES)
    text = C.render(F.lit("{{PACKAGE_NAME}} {{PACKAGE_VERSION}}\n{{DEPENDENCY_LIST}}"), workload.context())
    return p.select("index", "depth", "name", "relative_dir", F.size("dependency_names").alias("dependencies"), text.alias("readme"))


@query(f"""WITH RECURSIVE {_PACKAGES}, dirs AS (SELECT index, 'node_modules/' || name AS dir FROM nm WHERE parent IS NULL UNION ALL SELECT n.index, dirs.dir || '/node_modules/' || n.name FROM nm n JOIN dirs ON n.parent = dirs.index),
c AS (SELECT string_split(dir || '/x', '/') AS c FROM dirs), a AS (SELECT DISTINCT array_to_string(list_slice(c, 1, k), '/') AS x FROM (SELECT c, unnest(range(0, len(c))) AS k FROM c))
SELECT {_B('(SELECT count(*) FROM nm)', 'package_count')}, CAST((SELECT max(depth) FROM nm) AS INTEGER) AS max_package_depth, {_B('(SELECT count(*) FROM a)', 'directory_count')}""")
def workload_summary(spark, d):
    p = keep(workload.packages(spark, 64, [4, 4, 3, 2], 3, _SCOPES), "packages")
    folders = path_ops.ancestors(p.select(F.concat("relative_dir", F.lit("/x")).alias("path")))
    return p.agg(F.count("*").alias("package_count"), F.max("depth").alias("max_package_depth")).join(folders.agg(F.count("*").alias("directory_count")), F.lit(True))  # one row each


@query(f"""WITH RECURSIVE {_PACKAGES}, dirs AS (SELECT index, 'node_modules/' || name AS dir FROM nm WHERE parent IS NULL UNION ALL SELECT n.index, dirs.dir || '/node_modules/' || n.name FROM nm n JOIN dirs ON n.parent = dirs.index),
c AS (SELECT string_split(dir || '/x', '/') AS c FROM dirs), a AS (SELECT DISTINCT array_to_string(list_slice(c, 1, k), '/') AS x FROM (SELECT c, unnest(range(0, len(c))) AS k FROM c)),
orders_now AS (SELECT count(*) AS n FROM orders),
f AS (SELECT (SELECT count(*) FROM nm) AS package_count, (SELECT n FROM orders_now) AS regular_file_count, (SELECT max(depth) FROM nm) AS max_package_depth, (SELECT count(*) FROM a) AS directory_count),
t AS (SELECT 'package_count' AS term, 10560 AS expected, package_count AS found, package_count = 10560 AS kept FROM f UNION ALL SELECT 'regular_file_count', 105601, regular_file_count, regular_file_count = 105601 FROM f
  UNION ALL SELECT 'max_package_depth', 5, max_package_depth, max_package_depth = 5 FROM f UNION ALL SELECT 'directory_count', 29040, directory_count, directory_count >= 29040 FROM f)
SELECT term, CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found FROM t WHERE NOT kept""")
def contract_check(spark, d):
    """The terms of a contract that the generated packages' folders, with as many files as there are orders, don't keep."""
    found = workload_summary(spark, d).withColumn("regular_file_count", F.lit(table(spark, d, "orders").count()))
    return workload.broken_terms(found, {"package_count": 10560, "regular_file_count": 105601, "max_package_depth": 5, "min_directory_count": 29040})


# -- containers and streams ------------------------------------------------------------------------------------------


_made: dict[tuple, tuple[str, dict]] = {}


def _packed(spark, d, **how) -> tuple[str, dict]:
    """A container of the documents' tree, made once a session, and the statistics of packing it."""
    import os
    import uuid

    from .tables import shared_folder

    key = (spark.sparkContext.applicationId, d, *sorted(how.items()))
    if key not in _made:
        folder = shared_folder(spark).removeprefix("file://")
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/archive-{uuid.uuid4().hex}"
        e = keep(_docs(spark, d, text=True), "entries")
        contents = e.where(planner.carries_data()).select("entry_id", F.col("text").cast("binary").alias("content"))
        said = pack_plan.pack(spark, e, path, PackConfig(bundle_target_bytes=TARGET, small_file_threshold=THRESHOLD, threads=4, **how), contents)
        _made[key] = path, said.first().asDict()
    return _made[key]


def _container(spark, d, **how) -> str:
    return _packed(spark, d, **how)[0]


@query(f"WITH {_DOCS} SELECT entry_id, parent_id, path, kind, size, master AS hardlink_master_entry_id FROM told")
def container_entries(spark, d):
    """Entries read back from a container that was written."""
    from .plans.dump import entry_rows
    from .sources.container import read_container

    return entry_rows(read_container(spark, _container(spark, d), "entries").drop("archive")).select("entry_id", "parent_id", "path", "kind", "size", "hardlink_master_entry_id")


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN} SELECT bundle_id, {_B('sum(raw_len)', 'raw_len')} FROM extents GROUP BY bundle_id")
def container_frames(spark, d):
    """Frames of all bundles, read back from a container."""
    from .sources.container import read_container

    return read_container(spark, _container(spark, d, integrity="strong"), "frames").select("bundle_id", "raw_len")


_COUNTED = f"""SELECT {_B("(SELECT count(*) FROM told)", "entry_count")}, {_B("(SELECT count(*) FROM extents)", "extent_count")}, {_B("(SELECT count(DISTINCT bundle_id) FROM extents)", "bundle_count")}, {_B("(SELECT sum(raw_len) FROM extents)", "raw_bytes")}"""


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN}, n AS ({_COUNTED}) SELECT 1 AS version_major, 'zstd' AS data_codec, 'strong' AS integrity_mode, entry_count, extent_count, bundle_count, bundle_count AS frame_count, raw_bytes AS total_frame_raw_bytes, true AS has_trailer, true AS adds_up FROM n")
def container_dump(spark, d):
    """The one-row summary of a container's dump; encoded sizes, which depend on the codec's build, have to add up to the file's."""
    from .plans.dump import archive_summary

    r = archive_summary(spark, _container(spark, d, integrity="strong"))
    parts = F.lit(layout.HEADER_LEN + layout.TRAILER_LEN) + F.col("manifest_encoded_len") + F.col("total_frame_encoded_bytes") + F.col("frame_count") * layout.FRAME_LEN
    return r.select("version_major", "data_codec", "integrity_mode", "entry_count", "extent_count", "bundle_count", "frame_count", "total_frame_raw_bytes", "has_trailer", (F.col("archive_bytes") == parts).alias("adds_up"))


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN} SELECT t.path AS entry_path, x.entry_id, bundle_id, file_offset, raw_offset_in_bundle, raw_len FROM extents x JOIN told t USING (entry_id)")
def dump_file(spark, d):
    """Extents as the JSON file of a dump tells them."""
    import uuid

    from .plans.dump import dumped_extents, write_dump
    from .tables import shared_folder

    path = f"{shared_folder(spark).removeprefix('file://')}/dump-{uuid.uuid4().hex}.json"
    write_dump(spark, _container(spark, d, integrity="strong"), path)
    return dumped_extents(spark, path).select("entry_path", "entry_id", "bundle_id", "file_offset", "raw_offset_in_bundle", "raw_len")


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN} SELECT 'archive' AS archive, {_B('count(DISTINCT bundle_id)', 'frames')}, {_B('sum(raw_len)', 'raw_bytes')}, true AS matches_trailer FROM extents")
def stream_totals(spark, d):
    """Totals and digest of a stream of a container's frames, after all have come, against its trailer."""
    import uuid

    from .sources.container import read_container
    from .streaming.frames import frame_stream, running_trailers
    from .tables import shared_folder

    name, path = f"totals_{uuid.uuid4().hex}", _container(spark, d, integrity="strong")
    totals = running_trailers(frame_stream(spark, path).withColumn("archive", F.lit("archive")))
    q = totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    t = read_container(spark, path, "trailer").first()
    same = (F.col("archive_hash_hex") == t["archive_hash_hex"]) & (F.col("encoded_bytes") == t["total_encoded_bytes"])
    return spark.table(name).select("archive", "frames", "raw_bytes", same.alias("matches_trailer"))


# -- packing and restoring, whole ------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN}, n AS ({_COUNTED}) SELECT 'zstd' AS codec, 4 AS threads, {TARGET} AS bundle_target_bytes, {THRESHOLD} AS small_file_threshold, entry_count, bundle_count, raw_bytes, true AS size_is_the_file_s FROM n")
def pack_statistics(spark, d):
    """The statistics of packing the documents' tree; the encoded size has to be that of the file."""
    import os

    path, said = _packed(spark, d)
    names = ("codec", "threads", "bundle_target_bytes", "small_file_threshold", "entry_count", "bundle_count", "raw_bytes")
    rows = [(*(said[n] for n in names), said["encoded_bytes"] == os.path.getsize(path))]
    return spark.createDataFrame(rows, "codec string, threads long, bundle_target_bytes long, small_file_threshold long, entry_count long, bundle_count long, raw_bytes long, size_is_the_file_s boolean")


def _restored(spark, d, how: str) -> tuple[str, dict, dict]:
    """A folder that a container was restored to, the run's statistics and its counters."""
    import os
    import uuid

    from .tables import shared_folder

    path, counters = _container(spark, d, integrity="strong"), {}
    to = f"{shared_folder(spark).removeprefix('file://')}/restored-{uuid.uuid4().hex}"
    if how == "stream":
        with open(path, "rb") as f:
            said = unpack.unpack_stream(spark, f, to).first().asDict()
    else:
        os.environ[unpack.DIAGNOSTICS_ENV] = f"{to}.json"
        try:
            said = unpack.unpack(spark, path, to, counters=counters).first().asDict()
        finally:
            del os.environ[unpack.DIAGNOSTICS_ENV]
    return to, said, counters


def _contents(scan: DataFrame, root: str) -> DataFrame:
    """entry_id and sha256 of the files below root."""
    import hashlib
    import os

    import pyarrow as pa

    schema = pa.schema([("entry_id", pa.int64()), ("sha256", pa.string())])

    def work(batches):
        for batch in batches:
            out = []
            for entry_id, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(os.path.join(os.fsencode(root), name), "rb") as f:
                    out.append({"entry_id": entry_id, "sha256": hashlib.file_digest(f, "sha256").hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return scan.where("kind in ('regular', 'hardlink')").select("entry_id", "relative_path").mapInArrow(work, "entry_id long, sha256 string")


@query(f"""WITH {_DOCS} SELECT entry_id, parent_id, path, t.kind, size, master AS hardlink_master_entry_id, CASE WHEN id IS NOT NULL THEN sha256(coalesce(text, '')) END AS sha256,
  CASE WHEN t.kind = 'regular' THEN 1700000000 + id WHEN t.kind = 'directory' THEN 0 END AS mtime_sec, CASE t.kind WHEN 'root' THEN NULL WHEN 'directory' THEN '0o40755' ELSE '0o100644' END AS mode
FROM told t LEFT JOIN documents ON id = doc_id""")
def restored_tree(spark, d):
    """The documents' tree packed, restored into a folder, and scanned again: kinds, hard links, contents, times and modes."""
    from .sources.tree import read_tree

    to, *_ = _restored(spark, d, "file")
    e = keep(with_hardlinks(with_entry_ids(read_tree(spark, to))), "entries")
    own = F.col("kind") != "root"  # its metadata aren't restored
    mtime = F.when(own & (F.col("kind") != "hardlink"), F.col("mtime_sec"))
    return e.join(_contents(e, to), "entry_id", "left").select("entry_id", "parent_id", _path().alias("path"), "kind", "size", "hardlink_master_entry_id", "sha256", mtime.alias("mtime_sec"), F.when(own, C.octal_mode("mode")).alias("mode"))


_RESTORED = "SELECT 'regular_finalize_count' AS counter, count(*) FILTER (kind = 'regular') AS n FROM told UNION ALL SELECT 'dir_finalize_count', count(*) FILTER (kind = 'directory') FROM told UNION ALL SELECT 'hardlink_create_count', count(*) FILTER (kind = 'hardlink') FROM told UNION ALL SELECT 'file_create_count', count(*) FILTER (kind = 'regular') FROM told"


@query(f"""WITH RECURSIVE {_DOCS}, {_PLAN}, n AS ({_RESTORED} UNION ALL SELECT 'extents_written', count(*) FROM extents UNION ALL SELECT 'bytes_written', sum(raw_len) FROM extents
  UNION ALL SELECT 'bundles_observed', count(DISTINCT bundle_id) FROM extents UNION ALL SELECT 'total_bundle_extents', count(*) FROM extents UNION ALL SELECT 'total_bundle_unique_entries', sum(u) FROM (SELECT count(DISTINCT entry_id) AS u FROM extents GROUP BY bundle_id)
  UNION ALL SELECT 'max_bundle_extent_count', max(u) FROM (SELECT count(*) AS u FROM extents GROUP BY bundle_id) UNION ALL SELECT 'max_bundle_unique_entries', max(u) FROM (SELECT count(DISTINCT entry_id) AS u FROM extents GROUP BY bundle_id)
  UNION ALL SELECT 'symlink_create_count', 0 UNION ALL SELECT 'trailer_verify_count', 1) SELECT counter, CAST(n AS BIGINT) AS n FROM n""")
def restore_counters(spark, d):
    """What a run of unpack counted, as its diagnostics file tells it."""
    to, *_ = _restored(spark, d, "file")
    told = spark.read.json(f"file://{to}.json", multiLine=True).select("diagnostics.*")
    names = "regular_finalize_count dir_finalize_count hardlink_create_count file_create_count extents_written bytes_written bundles_observed total_bundle_extents total_bundle_unique_entries max_bundle_extent_count max_bundle_unique_entries symlink_create_count trailer_verify_count".split()
    group = {n: g for g, ns in unpack.DIAGNOSTICS.items() for n in ns.split()}
    return told.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(f"{group[n]}.{n}").cast("long").alias("n")) for n in names])).alias("c")).select("c.*")


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN}, n AS ({_COUNTED}) SELECT 'zstd' AS codec, entry_count, bundle_count, raw_bytes, {_B('(SELECT count(*) FROM told)', 'found_entries')}, {_B('(SELECT count(*) FROM told WHERE id IS NOT NULL)', 'found_files')}, {_B('(SELECT count(*) FROM told WHERE id IS NULL)', 'found_folders')}, {_B('(SELECT sum(size) FROM told)', 'found_bytes')} FROM n")
def restored_stream(spark, d):
    """The statistics of restoring a container that is read as a stream, and the totals of the folder it leaves."""
    from .sources.tree import read_tree

    to, said, _ = _restored(spark, d, "stream")
    t = pack_plan.tree_totals(read_tree(spark, to)).first()
    return spark.createDataFrame([(said["codec"], said["entry_count"], said["bundle_count"], said["raw_bytes"], t["entry_count"], t["regular_file_count"], t["directory_count"], t["raw_bytes"])], "codec string, entry_count long, bundle_count long, raw_bytes long, found_entries long, found_files long, found_folders long, found_bytes long")


@query("SELECT r_name || '/' || n_name AS path, 'symlink' AS kind, '../' || n_nationkey || '/' || n_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'directory', NULL FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def symbolic_links(spark, d):
    """Symbolic links made and scanned again: their targets' bytes, without following them."""
    import uuid

    from .operators import restore
    from .sources.tree import read_tree
    from .tables import shared_folder

    to = f"{shared_folder(spark).removeprefix('file://')}/links-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.array(F.col("r_name").cast("binary"), F.col("n_name").cast("binary")).alias("components"), F.concat(F.lit("../"), F.col("n_nationkey").cast("string"), F.lit("/"), F.col("n_name")).cast("binary").alias("link_target"))
    restore.make_folders(rows.select(F.slice("components", 1, 1).alias("components"), F.lit(1).alias("depth")).distinct(), to)
    restore.make_symlinks(rows, to)
    return read_tree(spark, to).where("kind <> 'root'").select(_path().alias("path"), "kind", C.lossy_utf8("symlink_target").alias("target"))


@query(f"WITH RECURSIVE {_DOCS}, {_PLAN}, n AS ({_COUNTED}) SELECT 'zstd' AS data_codec, 'zstd' AS manifest_codec, 'strong' AS integrity_mode, 4 AS suggested_parallelism, {TARGET} AS bundle_target_bytes, {THRESHOLD} AS small_file_threshold, entry_count, extent_count, bundle_count FROM n")
def container_header(spark, d):
    """The header that a container holds."""
    from .sources.container import read_container

    return read_container(spark, _container(spark, d, integrity="strong"), "header").select("data_codec", "manifest_codec", "integrity_mode", "suggested_parallelism", "bundle_target_bytes", "small_file_threshold", "entry_count", "extent_count", "bundle_count")
