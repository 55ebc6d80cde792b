"""Queries over the driver's tables, each with a DuckDB twin.

The tables hold no images, so slides, levels and requests are integer projections of
part and events; the operators are those of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dimensions as dims
from ..functions import geometry as g
from ..functions import addresses, signing, text
from ..operators import caches, catalog, chains, jpeg, pyramid, requests, reuse, validation, views
from ..sources import tiff_batch

SECRET, NOW = "tile-secret", 1_706_000_000
DOWNSAMPLES = (1, 2, 3, 8, 64)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- projections -------------------------------------------------------------------------------

EXTENSIONS = {0: ".svs", 1: ".TIF", 2: ".tiff", 3: ".jpg", 4: ".pdf"}


def _slides(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part")
    ext = dims.lookup((F.col("p_partkey") % 5).cast("int"), EXTENSIONS)
    name = F.concat(F.lit("cohort"), (F.col("p_partkey") % 7).cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), ext)
    return p.select("p_partkey", name.alias("slide_id"))


def _ifds(spark: SparkSession, d: str) -> DataFrame:
    """Six directories a slide, each smaller by 2 or 4 than the one before."""
    p = _table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ifd_index"))
    k = F.col("p_partkey")
    step = g.shift(F.col("ifd_index") * (1 + F.col("p_size") % 2))
    tile = F.when(F.col("p_size") % 2 == 1, 256).otherwise(240).cast("long")
    return p.select(
        k.alias("slide_id"), "ifd_index", g.ceil_div(300 + k * 7919 % 60000, step).alias("width"), g.ceil_div(300 + k * 104729 % 45000, step).alias("height"),
        tile.alias("tile_width"), tile.alias("tile_height"), F.lit(True).alias("has_tiles"),
        dims.lookup((k % 4).cast("int"), {0: 7, 1: 7, 2: 33003, 3: 5}).cast("int").alias("compression"),
    )


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    v = F.floor("value").cast("long")
    return e.select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("slide_id"), (F.col("event_id") % 6).cast("int").alias("level"),
        (v % 300).alias("tile_x"), (F.col("event_id") % 200).alias("tile_y"), (v % 110).cast("int").alias("quality"),
    )


_SLIDES = """slides AS (SELECT p_partkey, 'cohort' || (p_partkey % 7) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey ||
  CASE p_partkey % 5 WHEN 0 THEN '.svs' WHEN 1 THEN '.TIF' WHEN 2 THEN '.tiff' WHEN 3 THEN '.jpg' ELSE '.pdf' END AS slide_id FROM part)"""
_IFDS = """ifds AS (SELECT p_partkey AS slide_id, k::INT AS ifd_index,
  (300 + p_partkey * 7919 % 60000 + s - 1) // s AS width, (300 + p_partkey * 104729 % 45000 + s - 1) // s AS height,
  CASE WHEN p_size % 2 = 1 THEN 256 ELSE 240 END::BIGINT AS tile, CASE p_partkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 33003 ELSE 5 END AS compression
  FROM (SELECT *, (1::BIGINT << (k * (1 + p_size % 2))::INT) AS s FROM part, range(6) r(k)))"""
_CLASSIFIED = _IFDS + """, grid AS (SELECT *, (width + tile - 1) // tile AS tiles_x, (height + tile - 1) // tile AS tiles_y FROM ifds),
cand AS (SELECT *, width >= 256 AND height >= 256 AND NOT (width <= 1000 AND height <= 1000 AND width / height > 0.5 AND width / height < 2.0) AS c FROM grid),
ranked AS (SELECT *, CASE WHEN c THEN row_number() OVER w - 1 END AS rank, CASE WHEN c THEN (first(width) OVER w / width + first(height) OVER w / height) / 2 END AS downsample
  FROM cand WINDOW w AS (PARTITION BY slide_id, c ORDER BY width * height DESC, ifd_index)),
kinds AS (SELECT *, CASE WHEN NOT c THEN 'other' WHEN CASE WHEN rank = 0 THEN abs(downsample - 1) < 0.1
   ELSE round(log2(downsample)) >= 1 AND downsample / pow(2.0, round(log2(downsample))) > 0.8 AND downsample / pow(2.0, round(log2(downsample))) < 1.2 END THEN 'level' ELSE 'rejected' END AS kind FROM ranked),
levels AS (SELECT slide_id, (row_number() OVER (PARTITION BY slide_id ORDER BY rank) - 1)::INT AS level, ifd_index, width, height, tile, tiles_x, tiles_y, downsample, compression FROM kinds WHERE kind = 'level')"""
_REQUESTS = """requests AS (SELECT event_id AS request_id, user_id AS slide_id, (event_id % 6)::INT AS level, floor(value)::BIGINT % 300 AS tile_x, event_id % 200 AS tile_y,
  (floor(value)::BIGINT % 110)::INT AS quality FROM events)"""


# ---- pyramids ----------------------------------------------------------------------------------


@query(f"WITH {_IFDS} SELECT slide_id, ifd_index, (width + tile - 1) // tile AS tiles_x, (height + tile - 1) // tile AS tiles_y, ((width + tile - 1) // tile) * ((height + tile - 1) // tile) AS tile_count FROM ifds")
def q01_tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.with_grid(_ifds(spark, d)).select("slide_id", "ifd_index", "tiles_x", "tiles_y", "tile_count")


@query(f"WITH {_CLASSIFIED} SELECT slide_id, ifd_index, width, height FROM cand WHERE c")
def q02_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _ifds(spark, d).filter(g.is_candidate(F.col("width"), F.col("height"), F.col("has_tiles"))).select("slide_id", "ifd_index", "width", "height")


@query(f"WITH {_CLASSIFIED} SELECT slide_id, level, ifd_index, width, height, tiles_x, tiles_y, downsample FROM levels")
def q03_levels(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.build(_ifds(spark, d)).select("slide_id", F.col("level").cast("int").alias("level"), "ifd_index", "width", "height", "tiles_x", "tiles_y", "downsample")


@query(f"""WITH {_CLASSIFIED}, c AS (SELECT DISTINCT slide_id, level, width, height, tile, x, y FROM (SELECT *, unnest([0, tiles_x - 1]) AS x FROM levels) JOIN
 (SELECT slide_id AS s, level AS l, unnest([0, tiles_y - 1]) AS y FROM levels) ON s = slide_id AND l = level)
SELECT slide_id, level, x AS tile_x, y AS tile_y, least(tile, width - x * tile) AS tile_width, least(tile, height - y * tile) AS tile_height FROM c""")
def q04_edge_tiles(spark: SparkSession, d: str) -> DataFrame:
    lv = pyramid.build(_ifds(spark, d))
    ends = lambda c: F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col(c) - 1)))
    c = lv.withColumn("tile_x", ends("tiles_x")).withColumn("tile_y", ends("tiles_y"))
    side = lambda p, t, s: g.tile_side(F.col(p), F.col(t), F.col(s))
    return c.select(
        "slide_id", F.col("level").cast("int").alias("level"), "tile_x", "tile_y",
        side("tile_x", "tile_width", "width").alias("w"), side("tile_y", "tile_height", "height").alias("h"),
    ).withColumnsRenamed({"w": "tile_width", "h": "tile_height"})


def _wanted(lv: DataFrame) -> DataFrame:
    return lv.filter("level = 0").select("slide_id", F.explode(F.array(*[F.lit(float(x)) for x in DOWNSAMPLES])).alias("d"))


_WANTED = "wanted AS (SELECT slide_id, unnest([1.0, 2.0, 3.0, 8.0, 64.0])::DOUBLE AS d FROM levels WHERE level = 0)"


@query(f"""WITH {_CLASSIFIED}, {_WANTED} SELECT w.slide_id, d, coalesce(arg_min(level, downsample) FILTER (downsample >= 0.99 * d), max(level)) AS level
FROM wanted w JOIN levels l ON l.slide_id = w.slide_id GROUP BY w.slide_id, d""")
def q05_best_level(spark: SparkSession, d: str) -> DataFrame:
    lv = pyramid.build(_ifds(spark, d))
    return pyramid.best_level(lv, _wanted(lv)).withColumn("level", F.col("level").cast("int"))


@query(f"WITH {_CLASSIFIED} SELECT slide_id, ifd_index, kind FROM kinds")
def q06_partition_ifds(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.classify(_ifds(spark, d)).select("slide_id", "ifd_index", "kind")


# ---- requests ----------------------------------------------------------------------------------

_RESOLVED = f"""{_CLASSIFIED}, {_REQUESTS}, n AS (SELECT slide_id, count(*) AS n FROM levels GROUP BY 1),
resolved AS (SELECT r.*, CASE WHEN quality NOT BETWEEN 1 AND 100 THEN 'invalid_quality' WHEN n.n IS NULL THEN 'not_found' WHEN r.level >= n.n THEN 'invalid_level'
  WHEN NOT (tile_x < tiles_x AND tile_y < tiles_y) THEN 'tile_out_of_bounds' END AS error, tile_y * tiles_x + tile_x AS i
  FROM requests r LEFT JOIN n ON n.slide_id = r.slide_id LEFT JOIN levels l ON l.slide_id = r.slide_id AND l.level = r.level)"""


@query(f"""WITH {_RESOLVED} SELECT request_id, slide_id, level, tile_x, tile_y, quality,
CASE error WHEN 'not_found' THEN 404 WHEN 'invalid_quality' THEN 400 WHEN 'invalid_level' THEN 400 WHEN 'tile_out_of_bounds' THEN 400 ELSE 200 END AS status,
error, CASE WHEN error IS NULL THEN i END AS tile_index FROM resolved""")
def q07_resolve_requests(spark: SparkSession, d: str) -> DataFrame:
    return requests.resolve(_requests(spark, d), pyramid.build(_ifds(spark, d))).drop("message")


@query("""SELECT 'found' AS kind, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'missing', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def q08_found_missing(spark: SparkSession, d: str) -> DataFrame:
    r = _table(spark, d, "orders").select(F.col("o_custkey").alias("slide_id"))
    s = _table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("slide_id"))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(requests.found(r, s), "found").union(count(requests.missing(r, s), "missing"))


@query(f"WITH {_SLIDES} SELECT slide_id FROM slides WHERE regexp_matches(lower(slide_id), '\\.(svs|tif|tiff)$') AND starts_with(slide_id, 'cohort3/') AND contains(lower(slide_id), lower('A'))")
def q09_listing(spark: SparkSession, d: str) -> DataFrame:
    return catalog.matching(_slides(spark, d).select("slide_id"), "cohort3/", "A")


@query(f"""WITH {_SLIDES}, p AS (SELECT slide_id, row_number() OVER (ORDER BY slide_id) AS i FROM slides WHERE regexp_matches(lower(slide_id), '\\.(svs|tif|tiff)$') AND slide_id > 'cohort2' ORDER BY slide_id LIMIT 51)
SELECT slide_id, (SELECT q.slide_id FROM p q WHERE q.i = 50 AND EXISTS (SELECT 1 FROM p z WHERE z.i = 51)) AS next_cursor FROM p WHERE i <= 50""")
def q10_page(spark: SparkSession, d: str) -> DataFrame:
    return catalog.page(_slides(spark, d).select("slide_id"), 50, cursor="cohort2")


@query(f"""WITH {_CLASSIFIED}, m AS (SELECT slide_id, count(*) OVER (PARTITION BY slide_id) AS level_count, max(CASE WHEN level = 0 THEN width END) OVER (PARTITION BY slide_id) AS base_width,
max(CASE WHEN level = 0 THEN height END) OVER (PARTITION BY slide_id) AS base_height, level, width, tiles_x, downsample FROM levels) SELECT slide_id, level_count::INT AS level_count, base_width, base_height, level, width, tiles_x, downsample FROM m""")
def q11_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = pyramid.metadata(pyramid.build(_ifds(spark, d)))
    each = m.select("slide_id", "level_count", F.col("width").alias("base_width"), F.col("height").alias("base_height"), F.explode("levels").alias("l"))
    return each.select("slide_id", "level_count", "base_width", "base_height", F.col("l.level").cast("int").alias("level"), "l.width", "l.tiles_x", "l.downsample")


# ---- deep zoom ---------------------------------------------------------------------------------


@query(f"""WITH {_IFDS}, b AS (SELECT slide_id, width, height, tile, CASE WHEN greatest(width, height) <= 1 THEN 0 ELSE length(bin(greatest(width, height) - 1)) END::INT AS m FROM ifds WHERE ifd_index = 0),
l AS (SELECT *, unnest(range(m + 1))::INT AS dzi_level FROM b), s AS (SELECT *, (1::BIGINT << (m - dzi_level)) AS s FROM l),
x AS (SELECT *, greatest(1, (width + s - 1) // s) AS w, greatest(1, (height + s - 1) // s) AS h FROM s)
SELECT slide_id, m AS max_level, dzi_level, w AS dzi_width, h AS dzi_height, greatest(1, (w + tile - 1) // tile) AS dzi_tiles_x, greatest(1, (h + tile - 1) // tile) AS dzi_tiles_y, s::DOUBLE AS dzi_downsample FROM x""")
def q12_dzi_levels(spark: SparkSession, d: str) -> DataFrame:
    b = _ifds(spark, d).filter("ifd_index = 0").withColumn("max_level", g.max_dzi_level(F.col("width"), F.col("height")))
    x = b.withColumn("dzi_level", F.explode(F.sequence(F.lit(0), F.col("max_level"))))
    side = lambda c: g.dzi_side(F.col(c), F.col("dzi_level"), F.col("max_level"))
    x = x.withColumn("dzi_width", side("width")).withColumn("dzi_height", side("height"))
    return x.select(
        "slide_id", "max_level", "dzi_level", "dzi_width", "dzi_height", g.dzi_tiles(F.col("dzi_width"), F.col("tile_width")).alias("dzi_tiles_x"),
        g.dzi_tiles(F.col("dzi_height"), F.col("tile_height")).alias("dzi_tiles_y"), g.dzi_downsample(F.col("dzi_level"), F.col("max_level")).alias("dzi_downsample"),
    )


@query(f"""WITH {_CLASSIFIED}, {_WANTED}, b AS (SELECT w.slide_id, d, max(struct_pack(ds := downsample, l := level)) FILTER (downsample <= d) AS b FROM wanted w JOIN levels l ON l.slide_id = w.slide_id GROUP BY 1, 2)
SELECT slide_id, d, coalesce(b.l, 0)::INT AS level, d / coalesce(b.ds, 1.0) AS scale FROM b""")
def q13_dzi_to_level(spark: SparkSession, d: str) -> DataFrame:
    lv = pyramid.build(_ifds(spark, d))
    return pyramid.wsi_level(lv, _wanted(lv)).withColumn("level", F.col("level").cast("int"))


@query(f"WITH {_IFDS} SELECT slide_id, '" + text.DZI.replace("%d", "{}", 1).split("{}")[0] + "' || tile || '" + text.DZI.split("%d")[1] + "' || width || '" + text.DZI.split("%d")[2] + "' || height || '" + text.DZI.split("%d")[3] + "' AS xml FROM ifds WHERE ifd_index = 0")
def q14_dzi_xml(spark: SparkSession, d: str) -> DataFrame:
    return _ifds(spark, d).filter("ifd_index = 0").select("slide_id", text.dzi_xml(F.col("width"), F.col("height"), F.col("tile_width")).alias("xml"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    form = dims.lookup((k % 7).cast("int"), {0: "%s_%s.jpg", 1: "%s_%s.jpeg", 2: "%s_%s", 3: "%s-%s.jpg", 4: "+%s_%s.jpg", 5: "%s_%s_0.jpg", 6: "a%s_%s.png"})
    name = F.replace(F.regexp_replace(form, "%s_%s", "%s_{}"), F.lit("%s"), (k * 7919).cast("string"))
    return _table(spark, d, "part").select("p_partkey", F.replace(name, F.lit("{}"), (k * 104729 * 977).cast("string")).alias("name"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN a || '_' || b || '.jpg' WHEN 1 THEN a || '_' || b || '.jpeg' WHEN 2 THEN a || '_' || b WHEN 3 THEN a || '-' || a || '.jpg'
 WHEN 4 THEN '+' || a || '_' || b || '.jpg' WHEN 5 THEN a || '_' || b || '_0.jpg' ELSE 'a' || a || '_' || b || '.png' END AS name FROM (SELECT p_partkey, (p_partkey * 7919)::VARCHAR AS a, (p_partkey * 104729 * 977)::VARCHAR AS b FROM part)),
x AS (SELECT p_partkey, name, regexp_extract(name, '^\\+?([0-9]+)_\\+?([0-9]+)(\\.jpe?g)?$', ['a', 'b']) AS m, regexp_extract(name, '^\\+?([0-9]+)(\\.jpg)?$', 1) AS f FROM n),
y AS (SELECT *, try_cast(m.a AS BIGINT) AS a, try_cast(m.b AS BIGINT) AS b, try_cast(f AS BIGINT) AS fy FROM x)
SELECT p_partkey, name, CASE WHEN a <= 4294967295 AND b <= 4294967295 THEN a END AS x, CASE WHEN a <= 4294967295 AND b <= 4294967295 THEN b END AS y, CASE WHEN fy <= 4294967295 THEN fy END AS file_y FROM y""")
def q15_parse_names(spark: SparkSession, d: str) -> DataFrame:
    n = _names(spark, d).withColumn("c", text.dzi_tile_coords(F.col("name")))
    return n.select("p_partkey", "name", "c.x", "c.y", text.tile_file_y(F.col("name")).alias("file_y"))


# ---- signing -----------------------------------------------------------------------------------


def _urls(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    path = F.concat(F.lit("/tiles/slide%2F"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 6).cast("string"), F.lit("/1/2.jpg"))
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    params = F.array(pair("quality", F.floor("value") % 100), pair("event", F.col("event_type")))
    return e.select("event_id", "user_id", path.alias("path"), params.alias("params"), (F.lit(NOW) - 5000 + F.col("event_id") % 10000).alias("exp"))


_INNER = bytes(b ^ 0x36 for b in SECRET.encode().ljust(64, b"\0")).hex()
_OUTER = bytes(b ^ 0x5C for b in SECRET.encode().ljust(64, b"\0")).hex()


def _hmac_sql(message: str) -> str:
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({message}))))"


_URLS = f"""urls AS (SELECT event_id, user_id, '/tiles/slide%2F' || user_id || '/' || (event_id % 6) || '/1/2.jpg' AS path, event_type, (floor(value)::BIGINT % 100)::VARCHAR AS quality, {NOW} - 5000 + event_id % 10000 AS exp FROM events),
signed AS (SELECT *, path || '?event=' || event_type || '&exp=' || exp || '&quality=' || quality AS base FROM urls)"""


@query(f"WITH {_URLS} SELECT event_id, base, {_hmac_sql('base')} AS sig FROM signed")
def q16_sign(spark: SparkSession, d: str) -> DataFrame:
    u = _urls(spark, d)
    c = [F.col(x) for x in ("path", "params", "exp")]
    return u.select("event_id", signing.signature_base(*c).alias("base"), signing.sign(SECRET, *c).alias("sig"))


@query(f"""WITH {_URLS}, g AS (SELECT *, {_hmac_sql('base')} AS good, event_id % 8 AS k FROM signed)
SELECT event_id, CASE k WHEN 1 THEN 'missing_signature' WHEN 2 THEN 'missing_expiry' WHEN 4 THEN 'invalid_expiry_format' WHEN 6 THEN 'invalid_signature_format'
 ELSE CASE WHEN {NOW} > exp THEN 'signature_expired' WHEN k = 3 THEN 'invalid_signature_format' WHEN k = 5 THEN 'invalid_signature' END END AS error FROM g""")
def q17_access(spark: SparkSession, d: str) -> DataFrame:
    u = _urls(spark, d).withColumn("good", signing.sign(SECRET, F.col("path"), F.col("params"), F.col("exp"))).withColumn("k", F.col("event_id") % 8)
    pair = lambda k, v: F.array(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    sig = F.when(F.col("k") == 1, none).when(F.col("k") == 3, pair("sig", F.lit("xyz"))).when(F.col("k") == 5, pair("sig", F.reverse("good")))
    sig = sig.when(F.col("k") == 6, F.concat(pair("sig", F.col("good")), pair("sig", F.col("good")))).otherwise(pair("sig", F.col("good")))
    exp = F.when(F.col("k") == 2, none).when(F.col("k") == 4, pair("exp", F.lit("soon"))).otherwise(pair("exp", F.col("exp")))
    query = F.concat("params", exp, sig)
    return u.withColumn("query", query).select("event_id", signing.access_decision(SECRET, F.col("path"), F.col("query"), F.lit(NOW)).alias("error"))


@query(f"""WITH {_URLS} SELECT event_id, 'slide/' || user_id AS slide_id, {_hmac_sql("'viewer:slide/' || user_id || ':' || exp")} AS token FROM signed""")
def q18_viewer_token(spark: SparkSession, d: str) -> DataFrame:
    u = _urls(spark, d).withColumn("slide_id", signing.slide_id_of_path(F.col("path")))
    return u.select("event_id", "slide_id", signing.viewer_token(SECRET, F.col("slide_id"), F.col("exp")).alias("token"))


# ---- descriptions, dimensions, validation --------------------------------------------------------


def _descriptions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    head = F.when(k % 3 == 0, "Aperio Image\n 2000x1000").otherwise("Other")
    mpp = F.when(k % 5 == 0, "invalid").otherwise(F.format_string("0.%s", (k % 90 + 10).cast("string")))
    body = F.concat(head, F.lit("|MPP = "), mpp, F.lit("| AppMag = 20|Name="), F.col("p_brand"), F.lit("|noequals|AppMag =  40 "))
    return _table(spark, d, "part").select("p_partkey", F.when(k % 11 != 0, body).alias("description"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 THEN ('0.' || (p_partkey % 90 + 10))::DOUBLE END AS mpp, CASE WHEN p_partkey % 11 <> 0 THEN 40.0::DOUBLE END AS magnification,
CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 3 = 0 THEN 'Aperio' END AS vendor, CASE WHEN p_partkey % 11 <> 0 THEN 3 ELSE 0 END AS n_properties, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS name FROM part""")
def q19_descriptions(spark: SparkSession, d: str) -> DataFrame:
    m = _descriptions(spark, d).withColumn("m", text.vendor_metadata(F.col("description")))
    return m.select("p_partkey", "m.mpp", "m.magnification", "m.vendor", F.size("m.properties").alias("n_properties"), F.try_element_at("m.properties", F.lit("Name")).alias("name"))


@query("""WITH t(field_type_raw, field_type, bytes) AS (VALUES (1, 'Byte', 1), (2, 'Ascii', 1), (3, 'Short', 2), (4, 'Long', 4), (7, 'Undefined', 1), (16, 'Long8', 8)),
p AS (SELECT p_partkey, (p_partkey % 18)::INT AS field_type_raw, p_partkey % 6 AS n, CASE p_partkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 33003 ELSE 5 END AS compression FROM part)
SELECT p_partkey, t.field_type, coalesce(bytes * n <= 4, false) AS inline_classic, coalesce(bytes * n <= 8, false) AS inline_big,
CASE compression WHEN 7 THEN 'JPEG' WHEN 33003 THEN 'JPEG 2000' ELSE 'LZW' END AS compression_name, compression <> 5 AS supported FROM p LEFT JOIN t USING (field_type_raw)""")
def q20_dimensions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = _table(spark, d, "part").select(
        "p_partkey", (k % 18).cast("int").alias("raw"), (k % 6).alias("n"), dims.lookup((k % 4).cast("int"), {0: 7, 1: 7, 2: 33003, 3: 5}).alias("c")
    )
    fits = lambda big: dims.fits_inline(F.col("raw"), F.col("n"), F.lit(big))
    return p.select(
        "p_partkey", dims.lookup(F.col("raw"), {c: n for c, (n, _) in dims.FIELD_TYPES.items()}).alias("field_type"), fits(False).alias("inline_classic"), fits(True).alias("inline_big"),
        dims.lookup(F.col("c"), {c: n for c, (n, _) in dims.COMPRESSIONS.items()}).alias("compression_name"),
        dims.lookup(F.col("c"), {c: s for c, (_, s) in dims.COMPRESSIONS.items()}, False).alias("supported"),
    )


@query(f"""WITH {_CLASSIFIED}, e AS (SELECT slide_id, 'unsupported_compression' AS code, ifd_index, 'LZW' AS detail FROM levels WHERE compression = 5
UNION ALL SELECT slide_id, 'missing_tile_tags', ifd_index, 'TileByteCounts' FROM levels WHERE slide_id % 9 = 0)
SELECT p_partkey AS slide_id, e.code IS NULL AND n IS NOT NULL AS is_valid, CASE WHEN n IS NULL THEN 'no_pyramid_levels' ELSE e.code END AS code, e.ifd_index, e.detail
FROM part LEFT JOIN (SELECT slide_id, count(*) AS n FROM levels GROUP BY 1) c ON c.slide_id = p_partkey LEFT JOIN e ON e.slide_id = p_partkey""")
def q21_validate(spark: SparkSession, d: str) -> DataFrame:
    lv = pyramid.build(_ifds(spark, d))
    lv = lv.withColumn("has_offsets", F.lit(True)).withColumn("has_counts", F.col("slide_id") % 9 != 0).withColumn("has_jpeg_tables", F.lit(False))
    out = validation.check_pyramids(_table(spark, d, "part").select(F.col("p_partkey").alias("slide_id")), lv)
    return out.select("slide_id", "is_valid", F.explode_outer("errors").alias("e")).select("slide_id", "is_valid", "e.code", "e.ifd_index", "e.detail")


# ---- blocks and caches ---------------------------------------------------------------------------

BLOCK = 262_144


@query(f"""WITH e AS (SELECT l_orderkey % 97 AS slide_id, l_orderkey * 4099 AS o, l_quantity::BIGINT * 20011 AS n FROM lineitem),
b AS (SELECT DISTINCT slide_id, unnest(range(o // {BLOCK}, (o + n - 1) // {BLOCK} + 1)) AS b FROM e WHERE n > 0) SELECT slide_id, count(*) AS blocks FROM b GROUP BY 1""")
def q22_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 97).alias("slide_id"), (F.col("l_orderkey") * 4099).alias("offset"), (F.col("l_quantity").cast("long") * 20011).alias("length")
    )
    return requests.coalesced_reads(e, BLOCK).groupBy("slide_id").agg(F.count("*").alias("blocks"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    key = F.concat("event_type", (F.floor("value") % 3).cast("string"))
    op = F.when(F.col("event_id") % 3 == 0, "put").otherwise("get")
    return e.select(F.col("user_id").alias("shard"), F.col("event_id").alias("seq"), op.alias("op"), key.alias("key"), (F.floor("value").cast("long") + 1).alias("bytes"))


@query("""WITH r AS (SELECT user_id AS shard, event_id AS seq, event_type || (floor(value)::BIGINT % 3) AS key, lag(event_id) OVER (PARTITION BY user_id, event_type || (floor(value)::BIGINT % 3) ORDER BY event_id) AS prev FROM events),
d AS (SELECT a.shard, a.seq, count(DISTINCT b.key) AS n FROM r a JOIN r b ON a.shard = b.shard AND b.seq > a.prev AND b.seq < a.seq GROUP BY 1, 2)
SELECT r.shard, r.seq, r.key, prev IS NOT NULL AND coalesce(n, 0) < 4 AS hit FROM r LEFT JOIN d ON d.shard = r.shard AND d.seq = r.seq""")
def q23_lru(spark: SparkSession, d: str) -> DataFrame:
    return caches.replay_lru(_log(spark, d), 4).select("shard", "seq", "key", "hit")


@query("""WITH RECURSIVE log AS (
  SELECT user_id AS shard, event_id AS seq, event_type || (floor(value)::BIGINT % 3) AS key, CASE WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS op,
    floor(value)::BIGINT + 1 AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), r(shard, n, cache, seq, op, key, hit, n_evicted) AS (
  SELECT DISTINCT shard, 0::BIGINT, []::STRUCT(k VARCHAR, b BIGINT)[], NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BOOLEAN, 0 FROM log
  UNION ALL SELECT shard, n, after[gone + 1:], seq, op, key, hit, gone FROM (
    SELECT *, CASE WHEN op = 'get' THEN 0 ELSE len(list_filter(range(1, len(after) + 1), lambda i: list_sum(list_transform(after[i:], lambda x: x.b)) > 1500)) END::INT AS gone FROM (
      SELECT l.shard, l.n, l.seq, l.op, l.key, CASE WHEN l.op = 'get' THEN len(list_filter(r.cache, lambda x: x.k = l.key)) > 0 END AS hit,
        list_concat(list_filter(r.cache, lambda x: x.k <> l.key), CASE WHEN l.op = 'put' THEN [{'k': l.key, 'b': l.bytes}] ELSE list_filter(r.cache, lambda x: x.k = l.key) END) AS after
      FROM r JOIN log l ON l.shard = r.shard AND l.n = r.n + 1))
) SELECT shard, seq, op, key, hit, n_evicted FROM r WHERE n > 0""")
def q24_bytes_lru(spark: SparkSession, d: str) -> DataFrame:
    out = caches.replay_bytes_lru(_log(spark, d), 1500)
    return out.select("shard", "seq", "op", "key", "hit", F.size("evicted").alias("n_evicted"))


@query("""WITH RECURSIVE log AS (
  SELECT user_id AS shard, event_id AS seq, event_type || (floor(value)::BIGINT % 3) AS key, CASE WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS op,
    floor(value)::BIGINT + 1 AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), r(shard, n, cache, seq, key, hit, n_evicted) AS (
  SELECT DISTINCT shard, 0::BIGINT, []::VARCHAR[], NULL::BIGINT, NULL::VARCHAR, NULL::BOOLEAN, 0 FROM log
  UNION ALL SELECT l.shard, l.n, CASE WHEN list_contains(r.cache, l.key) THEN r.cache WHEN len(r.cache) >= 4 THEN list_append(r.cache[2:], l.key) ELSE list_append(r.cache, l.key) END,
    l.seq, l.key, list_contains(r.cache, l.key), (NOT list_contains(r.cache, l.key) AND len(r.cache) >= 4)::INT FROM r JOIN log l ON l.shard = r.shard AND l.n = r.n + 1
) SELECT shard, seq, key, hit, n_evicted FROM r WHERE n > 0""")
def q24_block_fifo(spark: SparkSession, d: str) -> DataFrame:
    return caches.replay_block_fifo(_log(spark, d), 4).select("shard", "seq", "key", "hit", F.size("evicted").alias("n_evicted"))


# ---- bytes ---------------------------------------------------------------------------------------


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("body"))
    full = F.col("doc_id") % 3 == 0
    scan = F.when(full, F.lit(b"\xff\xd8\xff\xdb\x00\x04\x01\x02\xff\xda")).otherwise(F.lit(b"\xff\xd8\xff\xda"))
    return t.select("doc_id", F.lit(b"\xff\xd8\xff\xdb\x00\x04\x07\x08\xff\xd9").alias("jpeg_tables"), F.concat(scan, "body", F.lit(b"\xff\xd9")).alias("data"))


@query("""SELECT doc_id, doc_id % 3 = 0 AS complete, doc_id % 3 <> 0 AS abbreviated, 'jpeg' AS format, sha256(CASE WHEN doc_id % 3 = 0 THEN unhex('FFD8FFDB00040102FFDA') ELSE unhex('FFD8FFDB00040708FFDA') END || encode(coalesce(text, '')) || unhex('FFD9')) AS prepared_sha256 FROM documents""")
def q25_jpeg_repair(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d)
    return t.select(
        "doc_id", jpeg.is_complete(F.col("data")).alias("complete"), jpeg.is_abbreviated("data").alias("abbreviated"), jpeg.tile_format(F.col("data")).alias("format"),
        F.sha2(jpeg.prepared(F.col("jpeg_tables"), F.col("data")), 256).alias("prepared_sha256"),
    )


@query(f"""WITH {_CLASSIFIED}, w AS (SELECT slide_id, greatest(width, height) AS longer, 16 + slide_id % 3000 AS max_size FROM levels WHERE level = 0),
s AS (SELECT *, greatest(64, least(2048, max_size)) AS size FROM w), b AS (SELECT s.slide_id, s.max_size, s.size, coalesce(arg_min(level, downsample) FILTER (downsample >= 0.99 * (longer / size)), max(level)) AS level FROM s JOIN levels l ON l.slide_id = s.slide_id GROUP BY 1, 2, 3)
SELECT b.slide_id, max_size, size, size <> max_size AS clamped, b.level, tiles_x = 1 AND tiles_y = 1 AS single_tile, round(width * (size / greatest(width, height)))::BIGINT AS out_width, round(height * (size / greatest(width, height)))::BIGINT AS out_height
FROM b JOIN levels l ON l.slide_id = b.slide_id AND l.level = b.level""")
def q26_thumbnails(spark: SparkSession, d: str) -> DataFrame:
    lv = pyramid.build(_ifds(spark, d))
    wanted = lv.filter("level = 0").select("slide_id", (16 + F.col("slide_id") % 3000).alias("max_size"))
    return requests.thumbnail_plan(wanted, lv).withColumn("level", F.col("level").cast("int"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_sha256 FROM pages""")
def q27_html_escape(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", F.sha2(text.html_escape(F.col("html")), 256).alias("escaped_sha256"))


@query("SELECT event_id, floor(value)::BIGINT % 110 BETWEEN 1 AND 100 AS valid, greatest(1, least(100, floor(value)::BIGINT % 110)) AS clamped FROM events")
def q28_quality(spark: SparkSession, d: str) -> DataFrame:
    q = F.floor("value").cast("long") % 110
    return _table(spark, d, "events").select("event_id", g.is_valid_quality(q).alias("valid"), g.clamp_quality(q).alias("clamped"))




# ---- more of directories, extents, addresses -------------------------------------------------------


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Tag entries of two directories a slide; the width stands twice, the later value counts."""
    k = F.col("p_partkey")
    entry = lambda n, tag, v: F.struct(F.lit(n).alias("entry_index"), F.lit(tag).alias("tag_id"), v.cast("long").alias("value"))
    listed = F.array(
        entry(0, 256, F.lit(1)), entry(1, 257, 300 + k % 900), entry(2, 259, dims.lookup((k % 3).cast("int"), {0: 7, 1: 5, 2: 33003})), entry(3, 256, 400 + k % 700 + F.col("ifd_index")),
        entry(4, 322, F.lit(256)), entry(5, 323, F.when(k % 4 == 0, 250).otherwise(256)), entry(6, 324, F.lit(0)), F.when(k % 5 == 0, entry(7, 273, F.lit(0))).otherwise(entry(7, 325, F.lit(0))),
    )
    p = _table(spark, d, "part").select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("ifd_index"))
    return p.select(k.alias("slide_id"), "ifd_index", F.explode(listed).alias("e")).select("slide_id", "ifd_index", "e.*")


_PIVOTED = """pivoted AS (SELECT p_partkey AS slide_id, i::INT AS ifd_index, 400 + p_partkey % 700 + i AS width, 300 + p_partkey % 900 AS height, 256 AS tile_width,
 CASE WHEN p_partkey % 4 = 0 THEN 250 ELSE 256 END AS tile_height, CASE p_partkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 5 ELSE 33003 END AS compression, p_partkey % 5 <> 0 AS has_tiles, p_partkey % 5 = 0 AS is_stripped FROM part, range(2) r(i))"""


@query(f"WITH {_PIVOTED} SELECT * FROM pivoted")
def q29_pivot_tags(spark: SparkSession, d: str) -> DataFrame:
    out = pyramid.pivot_tags(_entries(spark, d))
    return out.select("slide_id", "ifd_index", "width", "height", "tile_width", "tile_height", "compression", "has_tiles", "is_stripped")


@query(f"""WITH {_PIVOTED} SELECT slide_id, ifd_index, CASE WHEN compression = 5 THEN 'unsupported_compression' WHEN NOT has_tiles THEN 'missing_tile_tags' END AS error,
((compression = 5)::INT + (NOT has_tiles)::INT)::INT AS n_errors, (tile_height % 16 <> 0)::INT AS n_warnings FROM pivoted""")
def q30_validate_ifds(spark: SparkSession, d: str) -> DataFrame:
    i = pyramid.pivot_tags(_entries(spark, d)).withColumn("has_offsets", F.lit(True)).withColumn("has_counts", F.col("has_tiles"))
    out = validation.strict(validation.check_ifds(i))
    return out.select("slide_id", "ifd_index", F.col("error.code").alias("error"), F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


def _arrays(lv: DataFrame) -> DataFrame:
    index = F.sequence(F.lit(0).cast("long"), F.col("tile_count") - 1)
    return lv.select("*", F.transform(index, lambda i: 1000 + i * 4096).alias("offsets"), F.transform(index, lambda i: 100 + i % 977).alias("byte_counts"))


@query(f"""WITH {_RESOLVED} SELECT request_id, status, "offset", length FROM (SELECT request_id, CASE error WHEN 'not_found' THEN 404 WHEN 'invalid_quality' THEN 400 WHEN 'invalid_level' THEN 400 WHEN 'tile_out_of_bounds' THEN 400 ELSE 200 END AS status,
CASE WHEN error IS NULL AND level > 1 THEN 1000 + i * 4096 END AS "offset", CASE WHEN error IS NULL AND level > 1 THEN 100 + i % 977 END AS length FROM resolved)""")
def q31_tile_extents(spark: SparkSession, d: str) -> DataFrame:
    """Extents from offset and count arrays; arrays of the two largest levels are left out of this projection."""
    lv = pyramid.build(_ifds(spark, d))
    return requests.extents(requests.resolve(_requests(spark, d), lv), lv.filter("level > 1"), _arrays).select("request_id", "status", "offset", "length")


@query(f"""WITH {_URLS} SELECT event_id, 'http://host' || path || '?quality=' || quality || '&event=' || event_type || '&exp=' || exp || '&sig=' || {_hmac_sql('base')} AS url FROM signed""")
def q32_signed_urls(spark: SparkSession, d: str) -> DataFrame:
    u = _urls(spark, d)
    return u.select("event_id", signing.signed_url("http://host/", SECRET, F.col("path"), F.col("params"), F.col("exp")).alias("url"))


@query(f"WITH {_SLIDES} SELECT count(*) FILTER (regexp_matches(lower(slide_id), '\\.(svs|tif|tiff)$')) AS slides FROM (SELECT slide_id FROM slides ORDER BY slide_id LIMIT 1000)")
def q33_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return catalog.connectivity(_slides(spark, d).select("slide_id"))


@query("SELECT sum(floor(value)::BIGINT + 1)::BIGINT AS size, count(*) AS entries FROM events")
def q34_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return caches.cache_stats(_log(spark, d).withColumnRenamed("bytes", "length"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in dims.ERRORS.items()) + ") AS e(error, status)")
def q35_error_statuses(spark: SparkSession, d: str) -> DataFrame:
    return dims.errors(spark)


@query(f"""WITH {_RESOLVED} SELECT request_id, CASE error WHEN 'not_found' THEN 404 WHEN 'invalid_quality' THEN 400 WHEN 'invalid_level' THEN 400 WHEN 'tile_out_of_bounds' THEN 400 ELSE 200 END AS status,
CASE WHEN error IS NULL THEN 1000 + i * 4096 END AS "offset", CASE WHEN error IS NULL THEN 100 + i % 977 END AS length FROM resolved""")
def q36_tile_extents_all_levels(spark: SparkSession, d: str) -> DataFrame:
    """q31 with all levels: arrays are made a level at a time, of levels with accepted requests, and only wanted tiles taken out."""
    lv = pyramid.build(_ifds(spark, d))
    return requests.extents(requests.resolve(_requests(spark, d), lv), lv, _arrays).select("request_id", "status", "offset", "length")


# ---- orders over whole tables ------------------------------------------------------------------------

_REUSE = """r AS MATERIALIZED (SELECT user_id AS shard, event_id AS seq, event_type || (floor(value)::BIGINT % 3) AS key, lag(event_id) OVER (PARTITION BY user_id, event_type || (floor(value)::BIGINT % 3) ORDER BY event_id) AS prev FROM events),
d AS (SELECT a.shard, a.seq, count(DISTINCT b.key) AS n FROM r a JOIN r b ON a.shard = b.shard AND b.seq > a.prev AND b.seq < a.seq GROUP BY 1, 2),
x AS (SELECT r.shard, r.seq, r.key, CASE WHEN prev IS NOT NULL THEN coalesce(n, 0) END AS distance FROM r LEFT JOIN d ON d.shard = r.shard AND d.seq = r.seq)"""


@query(f"WITH {_REUSE} SELECT * FROM x")
def q37_reuse_distances(spark: SparkSession, d: str) -> DataFrame:
    return reuse.distances(_log(spark, d)).select("shard", "seq", "key", "distance")


@query(f"""WITH {_REUSE} SELECT DISTINCT shard, distance + 1 AS capacity, count(distance) OVER (PARTITION BY shard ORDER BY distance) AS hits, count(*) OVER (PARTITION BY shard) AS uses FROM x
QUALIFY distance IS NOT NULL""")
def q38_hit_shares(spark: SparkSession, d: str) -> DataFrame:
    """Hits of an LRU cache of every capacity, from one table of distances."""
    return reuse.hit_shares(reuse.distances(_log(spark, d)))


_READS = """e AS (SELECT l_orderkey % 97 AS slide_id, l_orderkey * 4099 AS o, l_orderkey * 4099 + l_quantity::BIGINT * 20011 AS e, row_number() OVER () AS k FROM lineitem WHERE l_quantity::BIGINT > 0),
m AS (SELECT *, max(e) OVER (PARTITION BY slide_id ORDER BY o, e, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM e),
i AS (SELECT *, max(CASE WHEN reached IS NULL OR o > reached + 100000 THEN o END) OVER (PARTITION BY slide_id ORDER BY o, e, k ROWS UNBOUNDED PRECEDING) AS island FROM m)"""


def _extents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 97).alias("slide_id"), (F.col("l_orderkey") * 4099).alias("offset"), (F.col("l_quantity").cast("long") * 20011).alias("length")
    )


@query(f"""WITH {_READS} SELECT slide_id, island, island AS start, max(e) AS "end", count(*) AS ranges FROM i GROUP BY 1, 2""")
def q39_read_islands(spark: SparkSession, d: str) -> DataFrame:
    return requests.read_plan(_extents(spark, d), gap=100_000)


@query(f"""WITH {_READS}, w AS (SELECT slide_id, island, max(e) AS e FROM i GROUP BY 1, 2), p AS (SELECT *, unnest(range((e - island - 1) // 1000000 + 1)) AS k FROM w),
n AS (SELECT slide_id, island, (o - island) // 1000000 AS k, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT slide_id, island, island + k * 1000000 AS start, least(island + (k + 1) * 1000000, e) AS "end", coalesce(n, 0) AS ranges FROM p LEFT JOIN n USING (slide_id, island, k)""")
def q40_reads(spark: SparkSession, d: str) -> DataFrame:
    """The same in reads of a megabyte at most."""
    return requests.read_plan(_extents(spark, d), gap=100_000, most=1_000_000)


@query(f"""WITH {_SLIDES}, k AS (SELECT slide_id, row_number() OVER (ORDER BY slide_id) - 1 AS i, count(*) OVER () AS n FROM slides WHERE regexp_matches(lower(slide_id), '\\.(svs|tif|tiff)$'))
SELECT slide_id, i // 7 AS page, i % 7 AS position, CASE WHEN (i // 7 + 1) * 7 < n THEN max(slide_id) OVER (PARTITION BY i // 7) END AS next_cursor FROM k""")
def q41_pages(spark: SparkSession, d: str) -> DataFrame:
    return catalog.pages(_slides(spark, d).select("slide_id"), 7)


@query(f"""WITH {_SLIDES}, s AS (SELECT s_suppkey AS search_id, CASE s_suppkey % 3 WHEN 0 THEN 'cohort' || (s_suppkey % 7) || '/' WHEN 1 THEN '' END AS prefix,
  CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN substr(n_name, 1, 2) ELSE substr(lower(s_name), 7 + (s_suppkey % 5)::INT, 4) || CASE WHEN s_suppkey % 5 = 2 THEN '' ELSE '.T' END END AS search
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT search_id, slide_id FROM s JOIN slides ON starts_with(slide_id, coalesce(prefix, '')) AND contains(lower(slide_id), lower(coalesce(search, ''))) WHERE regexp_matches(lower(slide_id), '\\.(svs|tif|tiff)$')""")
def q42_searches(spark: SparkSession, d: str) -> DataFrame:
    """A table of searches against all slides."""
    k = F.col("s_suppkey")
    s = _table(spark, d, "supplier").join(_table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    prefix = F.when(k % 3 == 0, F.concat(F.lit("cohort"), (k % 7).cast("string"), F.lit("/"))).when(k % 3 == 1, "")
    part = F.concat(F.substr(F.lower("s_name"), (7 + k % 5).cast("int"), F.lit(4)), F.when(k % 5 == 2, "").otherwise(".T"))
    search = F.when(k % 5 == 0, None).when(k % 5 == 1, F.substring("n_name", 1, 2)).otherwise(part)
    return catalog.searched(_slides(spark, d).select("slide_id"), s.select(k.alias("search_id"), prefix.alias("prefix"), search.alias("search")))


# ---- containers in a column ----------------------------------------------------------------------------


def _number(x, size: int, big_endian):
    """Hex digits of a number of `size` bytes in either byte order."""
    digits = F.lpad(F.hex(x.cast("long")), 2 * size, "0")
    return F.when(big_endian, digits).otherwise(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)]))


def _containers(spark: SparkSession, d: str) -> DataFrame:
    """A container of two directories for each part, in both byte orders and widths; some with a bad header."""
    k, n = F.col("p_partkey"), 1 + F.col("p_partkey") % 6
    mm, bad, at = k % 2 == 1, k % 13, F.sequence(F.lit(0).cast("long"), n - 1)

    def packed(big: bool):
        slot, head, base = (8, 16, 248) if big else (4, 8, 140)
        size = (base - head) // 2  # of a directory
        num = lambda x, size: _number(x, size, mm)
        lit = lambda x, size: num(F.lit(x), size)
        many = lambda f, size: F.array_join(F.transform(at, lambda i: num(f(i), size)), "")
        body, tail = [], []
        for i in (0, 1):
            offsets, counts = many(lambda j, i=i: 1000 + k * 7 + i * 5_000_000 + j * 4096, slot), many(lambda j, i=i: 100 + (k + j + i) % 977, 2)
            place = base + i * n * (slot + 2)
            entry = lambda tag, kind, count, value: F.concat(lit(tag, 2), lit(kind, 2), num(count, 8 if big else 4), F.rpad(value, 2 * slot, "0"))
            one = F.lit(1)
            body += [
                lit(5, 8 if big else 2), entry(256, 3, one, num(400 + k % 700 + i, 2)), entry(257, 4, one, num(300 + k % 90_000, 4)), entry(322, 3, one, lit(256, 2)),
                entry(324, 16 if big else 4, n, F.when(n == 1, offsets).otherwise(num(place, slot))), entry(325, 3, n, F.when(2 * n <= slot, counts).otherwise(num(place + n * slot, slot))),
                lit(0 if i else head + size, slot),
            ]
            tail += [offsets, counts]
        first = num(F.when(bad == 8, 1 << 30).otherwise(head), slot)
        version = num(F.when(bad == 7, 44).otherwise(43 if big else 42), 2)
        return F.concat(version, *([lit(8, 2), lit(0, 2)] if big else []), first, *body, *tail)

    order = F.when(bad == 6, "5858").when(mm, "4D4D").otherwise("4949")
    data = F.unhex(F.concat(order, F.when(k % 3 == 0, packed(True)).otherwise(packed(False))))
    data = F.when(bad == 5, F.substring(data, 1, 6)).otherwise(data)
    return _table(spark, d, "part").select(k.cast("string").alias("slide_id"), data.alias("data"))


_CONTAINERS = """c AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS slide_id, 1 + p_partkey % 6 AS n, p_partkey % 13 AS bad, p_partkey % 2 = 1 AS mm, p_partkey % 3 = 0 AS big, CASE WHEN p_partkey % 3 = 0 THEN 8 ELSE 4 END AS slot FROM part),
g AS (SELECT c.*, i::INT AS i FROM c, range(2) r(i) WHERE bad NOT BETWEEN 5 AND 8)"""


@query(f"""WITH {_CONTAINERS} SELECT slide_id, CASE WHEN bad = 5 THEN 6 ELSE CASE WHEN big THEN 248 ELSE 140 END + 2 * n * (slot + 2) END::BIGINT AS size,
CASE WHEN bad NOT IN (5, 6) THEN CASE WHEN mm THEN 'MM' ELSE 'II' END END AS byte_order, CASE WHEN bad NOT BETWEEN 5 AND 8 THEN big END AS is_bigtiff,
CASE WHEN bad NOT BETWEEN 5 AND 8 THEN CASE WHEN big THEN 16 ELSE 8 END END::BIGINT AS first_ifd_offset, CASE WHEN bad BETWEEN 5 AND 8 THEN 0 ELSE 2 END::INT AS directories,
CASE bad WHEN 5 THEN 'file_too_small' WHEN 6 THEN 'invalid_magic' WHEN 7 THEN 'invalid_version' WHEN 8 THEN 'invalid_ifd_offset' END AS error FROM c""")
def q43_headers(spark: SparkSession, d: str) -> DataFrame:
    return tiff_batch.headers(_containers(spark, d))


@query(f"""WITH {_CONTAINERS}, e AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS j FROM g)
SELECT slide_id, i AS ifd_index, j::INT AS entry_index, CASE j WHEN 0 THEN 256 WHEN 1 THEN 257 WHEN 2 THEN 322 WHEN 3 THEN 324 ELSE 325 END::INT AS tag_id,
CASE j WHEN 1 THEN 4 WHEN 3 THEN CASE WHEN big THEN 16 ELSE 4 END ELSE 3 END::INT AS field_type_raw, CASE WHEN j < 3 THEN 1 ELSE n END::BIGINT AS count,
CASE j WHEN 3 THEN n = 1 WHEN 4 THEN 2 * n <= slot ELSE true END AS is_inline,
CASE j WHEN 0 THEN 400 + k % 700 + i WHEN 1 THEN 300 + k % 90000 WHEN 2 THEN 256 WHEN 3 THEN CASE WHEN n = 1 THEN 1000 + k * 7 + i * 5000000 END ELSE CASE WHEN 2 * n <= slot THEN 100 + (k + i) % 977 END END::BIGINT AS value FROM e""")
def q44_entries(spark: SparkSession, d: str) -> DataFrame:
    return tiff_batch.entries(_containers(spark, d)).drop("value_bytes")


@query(f"""WITH {_CONTAINERS}, v AS (SELECT *, unnest(range(n)) AS j FROM g)
SELECT slide_id, i AS ifd_index, 324 AS tag_id, j::INT AS pos, 1000 + k * 7 + i * 5000000 + j * 4096 AS value FROM v UNION ALL SELECT slide_id, i, 325, j::INT, 100 + (k + j + i) % 977 FROM v""")
def q45_value_arrays(spark: SparkSession, d: str) -> DataFrame:
    out = tiff_batch.value_arrays(_containers(spark, d), [324, 325]).filter("error IS NULL")
    return out.select("slide_id", "ifd_index", "tag_id", F.posexplode("values").alias("pos", "value"))


_FRAMES = "f AS (SELECT doc_id, 1 + doc_id * 7 % 60000 AS w, 1 + doc_id * 13 % 50000 AS h, doc_id % 5 <> 0 AS has FROM documents)"


@query(f"WITH {_FRAMES} SELECT doc_id, CASE WHEN has THEN w END AS width, CASE WHEN has THEN h END AS height FROM f")
def q46_frame_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes from frame headers behind other segments, fill bytes and markers that stand alone, before a scan of text."""
    k = F.col("doc_id")
    two = lambda x: F.unhex(F.lpad(F.hex(x), 4, "0"))
    frame = F.concat(F.lit(b"\xff\xff\xc2\x00\x0b\x08"), two(1 + k * 13 % 50000), two(1 + k * 7 % 60000), F.lit(b"\x01\x01\x11\x00"))
    before = F.when(k % 3 == 0, F.lit(b"\xff\xe0\x00\x06\xff\xc0\x00\x11")).when(k % 3 == 1, F.lit(b"\xff\xd0\xff\x01\x00\x00\xff\xc4\x00\x03\x00")).otherwise(F.lit(b""))
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    data = F.concat(F.lit(b"\xff\xd8"), before, F.when(k % 5 != 0, frame).otherwise(F.lit(b"\xff\xc8\x00\x02")), F.lit(b"\xff\xda\x00\x02"), text, F.lit(b"\xff\xd9"))
    size = _table(spark, d, "documents").select("doc_id", jpeg.jpeg_size(data).alias("s"))
    return size.select("doc_id", "s.width", "s.height")


def _links(spark: SparkSession, d: str) -> DataFrame:
    """An order is a directory of its customer's chain; some customers share a long one, some last links lead back or nowhere."""
    c = F.col("o_custkey")
    o = _table(spark, d, "orders").select(F.when(c % 3 == 0, -1 - c % 30).otherwise(c).alias("slide_id"), (F.col("o_orderkey") + 1).alias("offset"))
    own = Window.partitionBy("slide_id").orderBy("offset")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = o.select("*", F.lead("offset").over(own).alias("following"), F.first("offset").over(whole).alias("head"), F.nth_value("offset", 3).over(whole).alias("third"))
    last = F.when(F.col("slide_id") % 7 == 0, F.coalesce("third", "head")).when(F.col("slide_id") % 11 == 0, F.col("offset") + 1_000_000_000).otherwise(0)
    return o.select("slide_id", "head", "offset", F.coalesce("following", last).alias("next_offset"))


_LINKS = """o AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN -1 - o_custkey % 30 ELSE o_custkey END AS slide_id, o_orderkey + 1 AS off FROM orders),
k AS MATERIALIZED (SELECT slide_id, off, first(off) OVER w AS head, coalesce(lead(off) OVER (PARTITION BY slide_id ORDER BY off),
  CASE WHEN slide_id % 7 = 0 THEN coalesce(nth_value(off, 3) OVER w, first(off) OVER w) WHEN slide_id % 11 = 0 THEN off + 1000000000 ELSE 0 END) AS nxt
  FROM o WINDOW w AS (PARTITION BY slide_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
walk(slide_id, pos, off) AS (SELECT DISTINCT slide_id, 0, head FROM k UNION ALL SELECT w.slide_id, w.pos + 1, k.nxt FROM walk w JOIN k ON k.slide_id = w.slide_id AND k.off = w.off WHERE w.pos < 99 AND k.nxt <> 0)"""


@query(f"WITH RECURSIVE {_LINKS} SELECT w.slide_id, pos::INT AS position, w.off AS \"offset\", nxt AS next_offset FROM walk w LEFT JOIN k ON k.slide_id = w.slide_id AND k.off = w.off")
def q47_chains(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return chains.followed(links.select("slide_id", F.col("head").alias("offset")).distinct(), links)


@query(f"""WITH RECURSIVE {_LINKS}, x AS (SELECT w.slide_id, pos, w.off, nxt FROM walk w LEFT JOIN k ON k.slide_id = w.slide_id AND k.off = w.off),
a AS (SELECT slide_id, off, min(pos) AS p, max(pos) AS q, count(*) AS n FROM x GROUP BY 1, 2), n AS (SELECT slide_id, nxt AS off FROM k WHERE nxt <> 0 GROUP BY 1, 2 HAVING count(*) > 1),
s AS (SELECT slide_id, count(*) AS s FROM a SEMI JOIN n USING (slide_id, off) GROUP BY 1),
l AS (SELECT slide_id, min(p) FILTER (n > 1) AS loop_at, min((q - p) // greatest(n - 1, 1)) FILTER (n > 1) AS loop_length FROM a GROUP BY 1),
e AS (SELECT slide_id, count(nxt) AS length, arg_max(coalesce(nxt, -1), pos) AS e FROM x GROUP BY 1)
SELECT e.slide_id, length::INT AS length, CASE WHEN loop_at IS NOT NULL THEN 'loop' WHEN e = -1 THEN 'broken' WHEN e = 0 THEN 'end' ELSE 'cut' END AS outcome, loop_at::INT AS loop_at, loop_length::INT AS loop_length, coalesce(s, 0)::INT AS shared
FROM e JOIN l USING (slide_id) LEFT JOIN s USING (slide_id)""")
def q48_chain_outcomes(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return chains.outcomes(links.select("slide_id", F.col("head").alias("offset")).distinct(), links)

# ---- accessors, addresses, messages, pages -----------------------------------------------------------------


@query(f"""WITH {_CLASSIFIED}, w AS (SELECT event_id, user_id AS slide_id, event_id % 9 - 2 AS level FROM events), n AS (SELECT slide_id, count(*) AS n, max(width) FILTER (level = 0) AS bw, max(height) FILTER (level = 0) AS bh FROM levels GROUP BY 1)
SELECT w.slide_id, w.level, coalesce(n, 0)::INT AS level_count, bw AS base_width, bh AS base_height, l.width, l.height, l.tile AS tile_width, l.tile AS tile_height, l.tiles_x, l.tiles_y, l.downsample
FROM w LEFT JOIN n ON n.slide_id = w.slide_id LEFT JOIN levels l ON l.slide_id = w.slide_id AND l.level = w.level""")
def q49_level_info(spark: SparkSession, d: str) -> DataFrame:
    wanted = _table(spark, d, "events").select(F.col("user_id").alias("slide_id"), (F.col("event_id") % 9 - 2).alias("level"))
    return pyramid.level_info(pyramid.build(_ifds(spark, d)), wanted)


@query("""WITH a AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 's3://' || p_brand || '/x/' || p_partkey WHEN 1 THEN ' ' || p_brand || ' ' WHEN 2 THEN 'http://' || p_brand WHEN 3 THEN 's3:///x' WHEN 4 THEN '' WHEN 5 THEN 's3://b' || p_partkey ELSE p_brand || '/y' END AS a FROM part),
t AS (SELECT *, trim(a) AS t FROM a), b AS (SELECT *, CASE WHEN starts_with(t, 's3://') THEN split_part(substr(t, 6), '/', 1) WHEN contains(t, '://') THEN '' ELSE t END AS b FROM t)
SELECT p_partkey, nullif(b, '') AS bucket, CASE WHEN t = '' THEN 'Bucket name cannot be empty' WHEN starts_with(t, 's3://') AND b = '' THEN 'Invalid S3 URI ''' || t || '''. Expected format: s3://bucket-name'
  WHEN b = '' THEN 'Invalid URI scheme in ''' || t || '''. Expected s3:// or plain bucket name' END AS error FROM b""")
def q50_buckets(spark: SparkSession, d: str) -> DataFrame:
    k, brand = F.col("p_partkey"), F.col("p_brand")
    kinds = {0: F.concat(F.lit("s3://"), brand, F.lit("/x/"), k.cast("string")), 1: F.concat(F.lit(" "), brand, F.lit(" ")), 2: F.concat(F.lit("http://"), brand), 3: F.lit("s3:///x"), 4: F.lit(""), 5: F.concat(F.lit("s3://b"), k.cast("string"))}
    address = F.concat(brand, F.lit("/y"))
    for i, own in kinds.items():
        address = F.when(k % 7 == i, own).otherwise(address)
    return _table(spark, d, "part").select("p_partkey", addresses.bucket(address).alias("b")).select("p_partkey", "b.bucket", "b.error")


@query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['quality=' || event_id, 'x=a=b'] WHEN 1 THEN ['plain', 'y'] WHEN 2 THEN ['=v', event_type || '='] END AS p FROM events)
SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN coalesce(array_to_string(list_transform(coalesce(p, []), lambda x: split_part(x, '=', 1) || ' is ' || substr(x, instr(x, '=') + 1)), ';'), '') END AS params,
CASE WHEN event_id % 4 = 1 THEN 'Invalid parameter format ''plain''. Expected key=value' END AS error FROM p""")
def q51_parameters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    given = F.when(k % 4 == 0, F.array(F.concat(F.lit("quality="), k.cast("string")), F.lit("x=a=b"))).when(k % 4 == 1, F.array(F.lit("plain"), F.lit("y"))).when(k % 4 == 2, F.array(F.lit("=v"), F.concat("event_type", F.lit("="))))
    p = _table(spark, d, "events").select("event_id", addresses.parameters(given).alias("p"))
    told = F.array_join(F.transform("p.params", lambda x: F.concat(x["k"], F.lit(" is "), x["v"])), ";")
    return p.select("event_id", told.alias("params"), "p.error")


@query(f"""WITH {_PIVOTED}, f AS (SELECT *, has_tiles OR slide_id % 2 <> 0 AS tiled FROM pivoted),
e AS (SELECT slide_id, ifd_index, 'strip_organization' AS code, 'Unsupported organization: file uses strips instead of tiles' AS message FROM f WHERE NOT tiled
UNION ALL SELECT slide_id, ifd_index, 'unsupported_compression', 'Unsupported compression: LZW (only JPEG and JPEG 2000 are supported)' FROM f WHERE tiled AND compression = 5
UNION ALL SELECT slide_id, ifd_index, 'missing_tag', 'Missing required tag: TileByteCounts' FROM f WHERE tiled AND NOT has_tiles
UNION ALL SELECT slide_id, ifd_index, 'invalid_tag_value', 'Invalid tag value for TileWidth/TileLength: Tile dimensions cannot be zero' FROM f WHERE tiled AND slide_id % 13 = 0) SELECT * FROM e""")
def q52_read_errors(spark: SparkSession, d: str) -> DataFrame:
    """Findings of directories as the errors that reading them tells."""
    i = pyramid.pivot_tags(_entries(spark, d)).withColumn("has_offsets", F.lit(True)).withColumn("has_counts", F.col("has_tiles"))
    i = i.withColumn("tile_width", F.when(F.col("slide_id") % 13 == 0, 0).otherwise(F.col("tile_width"))).withColumn("is_tiled", ~(F.col("is_stripped") & (F.col("slide_id") % 2 == 0)))
    e = validation.check_ifds(i).select("slide_id", "ifd_index", F.explode("errors").alias("e"))
    return e.select("slide_id", "ifd_index", validation.as_read_error(F.col("e")).alias("r")).select("slide_id", "ifd_index", "r.code", "r.message")


_NAMED = "'<' || slide_id || ' & \"x\">.svs'"
_PAGE = [(t.replace("'", "''"), n) for t, n, _, _ in views.Formatter().parse(views.PAGE)]
_FILLED = {
    "title": "'&lt;' || slide_id || ' &amp; &quot;x&quot;&gt;.svs'", "format": "''", "levels": "lv", "last": "n - 1", "width": "bw", "height": "bh", "tile": "bt", "base": "'http://host'",
    "id": "'%3C' || slide_id || '%20%26%20%22x%22%3E.svs'", "auth": f"'?exp={NOW}&vt=' || " + _hmac_sql(f"'viewer:' || {_NAMED} || ':{NOW}'"),
}


@query(f"""WITH {_CLASSIFIED}, s AS (SELECT slide_id, count(*) AS n, max(width) FILTER (level = 0) AS bw, max(height) FILTER (level = 0) AS bh, max(tile) FILTER (level = 0) AS bt,
  string_agg('{{level: ' || level || ', width: ' || width || ', height: ' || height || '}}', ', ' ORDER BY level) AS lv FROM levels GROUP BY 1)
SELECT {_NAMED} AS slide_id, sha256(""" + " || ".join(f"'{t}'" + (f" || ({_FILLED[n]})" if n else "") for t, n in _PAGE) + ") AS page_sha256 FROM s")
def q53_viewer_pages(spark: SparkSession, d: str) -> DataFrame:
    lv = pyramid.build(_ifds(spark, d)).withColumn("slide_id", F.concat(F.lit("<"), F.col("slide_id").cast("string"), F.lit(' & "x">.svs')))
    return views.viewer_pages(lv, SECRET, NOW, "http://host/").select("slide_id", F.sha2("body", 256).alias("page_sha256"))
