"""One query per operator over the fixture views, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, polygon
from ..operators import boxes, jobs, listing, pixels, pointing, spatial, spectra, stats, tiles, wcs
from ..scratch import written
from .fixtures import oracle, view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = oracle(sql)
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


# ---- boxes

_BASE = "coalesce(nullif(regexp_extract(filename, '^jw\\d{11}_\\d{5}_\\d{5}_[^_]+', 0), ''), filename)"


def _box(spark: SparkSession, d: str) -> DataFrame:
    return boxes.named(view(spark, d, "v_exposures"))


@query("select pupil, filter, detector, count(*) as n_files from v_exposures group by pupil, filter, detector")
def box_summary(spark, d):
    return boxes.summary(view(spark, d, "v_exposures"))


@query("select pupil, filter, detector, count(*) as n_files from v_exposures group by rollup (pupil, filter, detector)")
def box_summary_rollup(spark, d):
    return boxes.summary_rollup(view(spark, d, "v_exposures"))


@query(f"select {_BASE} as basename, regexp_extract(filename, '^jw\\d{{11}}_\\d{{5}}_\\d{{5}}', 0) as fileset, regexp_extract(filename, 'jw(\\d{{5}})', 1) as proposal_id, stage from v_exposures")
def exposure_names(spark, d):
    return _box(spark, d).select("basename", "fileset", "proposal_id", "stage")


@query("select exposure_id, (filename not like '%\\_uncal%' escape '\\' and filename not like '%\\_rate%' escape '\\') as expects_wcs from v_exposures")
def expects_wcs(spark, d):
    return _box(spark, d).select("exposure_id", "expects_wcs")


@query(f"select exposure_id, {_BASE} as basename from v_exposures where filter in ('F115W', 'F356W') and pupil in ('CLEAR')")
def select_condition(spark, d):
    return boxes.select(_box(spark, d), {"filter": ["F115W", "F356W"], "pupil": ["CLEAR"]}).select("exposure_id", "basename")


@query(f"select exposure_id, {_BASE} as basename from v_exposures where detector in ('NRCA1') or exposure_id % 10 = 3")
def select_union(spark, d):
    return boxes.select(_box(spark, d), {"detector": ["NRCA1"]}, F.col("exposure_id") % 10 == 3).select("exposure_id", "basename")


@query("select exposure_id, filter from v_exposures where filter not in ('F444W') and detector not in ('NRCB1', 'NRCBLONG') and stage = '2b'")
def hide_values(spark, d):
    return boxes.hide(_box(spark, d), {"filter": ["F444W"], "detector": ["NRCB1", "NRCBLONG"]}, "2b").select("exposure_id", "filter")


@query(f"""
with b as (select exposure_id, {_BASE} as basename from v_exposures),
t as (select regexp_extract(basename, '^jw\\d{{11}}_\\d{{5}}', 0) as prefix from b order by exposure_id limit 1)
select exposure_id, basename from b, t where contains(basename, prefix)""")
def example_visit(spark, d):
    box = _box(spark, d)
    target = box.orderBy("exposure_id").select("basename").first()[0]
    return boxes.example(box, target).select("exposure_id", "basename")


@query(f"""
with b as (select exposure_id, {_BASE} as basename, row_number() over (order by exposure_id) - 1 as ord from v_exposures)
select ord, basename from b where ord >= 10 and ord % 3 = 1 and ord < 1000""")
def lookup_slice(spark, d):
    return boxes.at(boxes.numbered(_box(spark, d)), slice(10, 1000, 3)).select("ord", "basename")


@query("select distinct regexp_extract(filename, 'jw(\\d{5})', 1) as proposal_id from v_exposures")
def proposal_ids(spark, d):
    return boxes.proposals(_box(spark, d))


@query("select p_partkey, lpad(ltrim(cast(p_partkey % 99999 + 1 as string), '0'), 5, '0') as proposal_id from part")
def normal_proposal_ids(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    raw = F.concat(F.lit(" 00"), (F.col("p_partkey") % 99999 + 1).cast("string"), F.lit(" "))
    return part.select("p_partkey", names.normal_proposal_id(raw).alias("proposal_id"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    box = _box(spark, d).select("exposure_id", "basename", "stage", F.col("filename").alias("filepath"))
    left = box.where(F.col("exposure_id") % 3 != 0).drop("exposure_id")
    right = box.where(F.col("exposure_id") % 3 != 1).withColumn("filepath", F.concat(F.lit("new/"), "filepath")).drop("exposure_id")
    return left, right


_SIDES = f"""
with b as (select exposure_id, {_BASE} as basename, stage, filename from v_exposures),
l as (select basename, stage, filename as filepath from b where exposure_id % 3 <> 0),
r as (select basename, stage, concat('new/', filename) as filepath from b where exposure_id % 3 <> 1)
"""


@query(_SIDES + "select coalesce(r.basename, l.basename) as basename, coalesce(r.stage, l.stage) as stage, coalesce(r.filepath, l.filepath) as filepath from l full join r on l.basename = r.basename and l.stage = r.stage")
def merge_boxes(spark, d):
    return boxes.merge(*_sides(spark, d))


@query(_SIDES + "select l.basename, l.stage, coalesce(r.filepath, l.filepath) as filepath from l left join r on l.basename = r.basename and l.stage = r.stage")
def merge_discard(spark, d):
    return boxes.merge(*_sides(spark, d), discard=True)


@query("select exposure_id, (regexp_matches(f, '^F[A-Z0-9]+$') and regexp_matches(detector, '^[A-Z0-9]+$') and regexp_matches(pupil, '^[A-Z0-9]+$')) as valid from (select *, case when exposure_id % 7 = 0 then lower(filter) else filter end as f from v_exposures) t")
def validate_exposures(spark, d):
    box = view(spark, d, "v_exposures").withColumn("filter", F.when(F.col("exposure_id") % 7 == 0, F.lower("filter")).otherwise(F.col("filter")))
    return boxes.validity(box).select("exposure_id", "valid")


@query(f"""
with b as (select exposure_id, {_BASE} as basename, filter, detector, pupil from v_exposures)
select exposure_id, basename from b where exposure_id % 5 = 2 and exposure_id % 2 = 0""")
def stage_conflicts(spark, d):
    """Exposures whose new stage names another pupil than the box."""
    box = _box(spark, d).select("exposure_id", "basename", "filter", "detector", "pupil", "stage")
    new = box.where(F.col("exposure_id") % 2 == 0).withColumn("stage", F.lit("3a")).withColumn("pupil", F.when(F.col("exposure_id") % 5 == 2, F.lit("OTHER")).otherwise(F.col("pupil")))
    return boxes.add_stage(box, new)[1].select("exposure_id", "basename")


@query("select exposure_id, combo from v_exposures join (select pupil, filter, row_number() over (order by pupil, filter) - 1 as combo from (select distinct pupil, filter from v_exposures) a) b using (pupil, filter)")
def combo_index(spark, d):
    return boxes.combo_index(view(spark, d, "v_exposures"), ("pupil", "filter"), 100).select("exposure_id", F.col("combo").cast("long").alias("combo"))


@query("select detector, min(exposure_id) as first_ord from v_exposures group by detector")
def first_contact(spark, d):
    return listing.first_contact(view(spark, d, "v_exposures"), "detector", "exposure_id")


@query(f"select {_BASE} as basename, pupil from v_exposures group by 1, 2")
def attribute_map(spark, d):
    return boxes.attributes(_box(spark, d), "pupil")


@query()
def random_sample(spark, d):
    """200 random exposures with all combinations of pupil and filter."""
    return boxes.sample(view(spark, d, "v_exposures"), 200, ("pupil", "filter"), 7)


# ---- listings


def _listing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "v_products"), view(spark, d, "v_search_results")


@query("select dataset, filename, category, size from v_products where category = '2b' and file_suffix not like '%rateint%' and dataset in (select fileset from v_search_results where access <> 'private')")
def listing_products(spark, d):
    return listing.open_products(*_listing(spark, d), level="2b").select("dataset", "filename", "category", "size")


@query("select fileset, access from v_search_results s where access <> 'private' and not exists (select 1 from v_products p where p.dataset = s.fileset and category = '2c')")
def listing_missing(spark, d):
    return listing.without_products(*_listing(spark, d), level="2c").select("fileset", "access")


@query("""
with p as (select instrument_name, dataset, substr(filename, length(cast(dataset as string)) + 2) as suffix from v_products)
select instrument_name, count(distinct suffix) as n_suffixes, count(distinct dataset) as n_filesets, count(distinct suffix) * count(distinct dataset) as n_files from p group by instrument_name""")
def files_per_instrument(spark, d):
    return listing.files_per_instrument(_listing(spark, d)[0])


@query("select access, count(*) as n from v_search_results group by access")
def access_counts(spark, d):
    return listing.frequency(_listing(spark, d)[1], "access")


@query("select filename, size from v_products p where not exists (select 1 from v_products q where q.filename = p.filename and q.size = p.size and q.size % 4 = 0 and q.size > 5000)")
def to_download(spark, d):
    p = _listing(spark, d)[0]
    present = p.where((F.col("size") % 4 == 0)).select("filename", F.when(F.col("size") > 5000, F.col("size")).otherwise(F.lit(-1)).alias("size")).distinct()
    return listing.to_download(p, present).select("filename", "size")


@query("select filename, concat(printf('%.2f', size / 1e6), ' MB') as size_text from (select filename, min(size) as size from v_products group by filename order by filename limit 5) t")
def product_preview(spark, d):
    p = _listing(spark, d)[0].groupBy("filename").agg(F.min("size").alias("size"))
    return listing.preview(p)


# ---- footprints


def _fps(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "v_footprints")
    return v.select("fp_id", "filter", polygon.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("vertices"))


_PAIR = """
p as (select a.fp_id as a, b.fp_id as b, a.filter as fa, b.filter as fb,
  (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as inter,
  least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) as small
  from v_footprints a join v_footprints b on a.fp_id < b.fp_id
  where least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0))
"""


@query("select fp_id, round((x0 + x1) / 2, 6) as cx, round((y0 + y1) / 2, 6) as cy, round((x1 - x0) * (y1 - y0), 9) as area, round(sqrt(power((x1 - x0) / 2, 2) + power((y1 - y0) / 2, 2)), 6) as radius from v_footprints")
def footprint_measures(spark, d):
    f = _fps(spark, d).withColumn("c", polygon.centroid(F.col("vertices")))
    return f.select("fp_id", r6("c.x").alias("cx"), r6("c.y").alias("cy"), F.round(polygon.area(F.col("vertices")), 9).alias("area"), r6(polygon.radius(F.col("vertices"), F.col("c"))).alias("radius"))


@query(f"with {_PAIR} select a, b, round(inter, 9) as inter_area, round(inter / small, 6) as fraction from p where inter / small >= 6e-1")
def overlap_pairs(spark, d):
    o = spatial.overlap_pairs(_fps(spark, d))
    return o.select("a", "b", F.round("inter_area", 9).alias("inter_area"), r6("fraction").alias("fraction"))


@query("""
with t as (select * from v_footprints where fp_id = 25)
select f.fp_id, round((least(f.x1, t.x1) - greatest(f.x0, t.x0)) * (least(f.y1, t.y1) - greatest(f.y0, t.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)), 6) as fraction
from v_footprints f, t where f.filter = t.filter and least(f.x1, t.x1) > greatest(f.x0, t.x0) and least(f.y1, t.y1) > greatest(f.y0, t.y0)
and (least(f.x1, t.x1) - greatest(f.x0, t.x0)) * (least(f.y1, t.y1) - greatest(f.y0, t.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 3e-1""")
def search_target(spark, d):
    f = _fps(spark, d)
    return spatial.search(f, f.where("fp_id = 25"), ("filter",), 0.3).select("fp_id", r6("fraction").alias("fraction"))


@query("""
with t as (select fp_id as target, filter, x0 as tx0, y0 as ty0, x1 as tx1, y1 as ty1 from v_footprints where fp_id % 100 = 0),
p as (select t.target, f.fp_id, least(x1, tx1) - greatest(x0, tx0) as w, least(y1, ty1) - greatest(y0, ty0) as h, (tx1 - tx0) * (ty1 - ty0) as whole from v_footprints f join t on f.filter = t.filter)
select target, fp_id, round(w * h / whole, 6) as fraction from p where w > 0 and h > 0 and w * h / whole >= 3e-1""")
def search_targets(spark, d):
    """Every footprint whose fp_id is divisible by 100, as a target against all footprints."""
    f = _fps(spark, d)
    return spatial.search(f, f.where("fp_id % 100 = 0"), ("filter",), 0.3).select("target", "fp_id", r6("fraction").alias("fraction"))


@query("select c.id, f.fp_id, c.ra, c.dec from v_catalog c join v_footprints f on c.ra > f.x0 and c.ra < f.x1 and c.dec > f.y0 and c.dec < f.y1")
def catalog_in_footprint(spark, d):
    return spatial.points_in_footprints(view(spark, d, "v_catalog"), _fps(spark, d)).select("id", "fp_id", "ra", "dec")


@query("""
with p as (select distinct id, ra, dec from v_catalog), c as (select fp_id, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from v_footprints),
r as (select id, ra, dec, min(round(power(cx - ra, 2) + power(cy - dec, 2), 12)) as d2 from p, c group by id, ra, dec)
select id, ra, dec, round(d2, 9) as d2 from r""")
def nearest_footprint(spark, d):
    """The distance to the nearest footprint; which of several at the same distance is tested on a small table."""
    return spatial.nearest_footprint(view(spark, d, "v_catalog"), _fps(spark, d)).select("id", "ra", "dec", F.round("d2", 9).alias("d2"))


_REACH = """
e as (select a as s, b as t from p where fa = fb and inter / small >= 6e-1 union all select b, a from p where fa = fb and inter / small >= 6e-1),
reach as (select fp_id as node, fp_id as seen from v_footprints union select r.node, e.t from reach r join e on r.seen = e.s),
comp as (select node as fp_id, min(seen) as component from reach group by node)
"""


@query(f"with /*recursive*/ {_PAIR}, {_REACH} select fp_id, component from comp")
def pointing_groups(spark, d):
    f = _fps(spark, d)
    pairs = spatial.overlap_pairs(f, same=("filter",)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return pointing.components_of(f.select("fp_id"), pairs, "fp_id")


@query()
def group_by_pointing(spark, d):
    """Overlap graph, components, union outlines and order together; held against a brute-force version in tests."""
    return pointing.group_by_pointing(_fps(spark, d))


_SEP = "degrees(acos(least(greatest(sin(radians(a.dec)) * sin(radians(b.dec)) + cos(radians(a.dec)) * cos(radians(b.dec)) * cos(radians(a.ra - b.ra)), -1e0), 1e0)))"
_CENTRES = "c as (select fp_id as id, (x0 + x1) / 2 as ra, (y0 + y1) / 2 as dec from v_footprints)"


def _centres(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_footprints").select(F.col("fp_id").alias("id"), ((F.col("x0") + F.col("x1")) / 2).alias("ra"), ((F.col("y0") + F.col("y1")) / 2).alias("dec"))


@query(f"with {_CENTRES}, s as (select a.id as a, b.id as b, {_SEP} as separation from c a join c b on a.id < b.id and abs(a.dec - b.dec) < 2e-2 and abs(a.ra - b.ra) < 1e-1) select a, b, round(separation, 6) as separation from s where separation > 0 and separation < 2e-2")
def near_pointings(spark, d):
    return spatial.near_pairs(_centres(spark, d), 0.02).select("a", "b", r6("separation").alias("separation"))


@query(f"""with /*recursive*/ {_CENTRES},
s as (select a.id as a, b.id as b, {_SEP} as separation from c a join c b on a.id <> b.id and abs(a.dec - b.dec) < 2e-2 and abs(a.ra - b.ra) < 1e-1),
reach as (select id as node, id as seen from c union select r.node, s.b from reach r join s on r.seen = s.a where separation > 0 and separation < 2e-2),
m as (select c.*, component from c join (select node, min(seen) as component from reach group by node) r on c.id = r.node),
g as (select component, max(dec) as top, min(id) as least_id, degrees(atan2(avg(sin(radians(ra))), avg(cos(radians(ra))))) as mean from m group by component)
select id, m.component, cast(row_number() over (order by top desc, least_id, dec desc, (ra - mean + 540) - 360 * floor((ra - mean + 540) / 360) - 180, id) - 1 as bigint) as place from m join g on m.component = g.component""")
def pointing_order(spark, d):
    return pointing.sort_pointings(_centres(spark, d), 0.02).select("id", "component", "place")


@query("select fp_id, pos, round(x, 6) as x, round(y, 6) as y from (select fp_id, unnest([0, 1, 2, 3, 4]) as pos, unnest([x0, x1, x1, x0, x0]) as x, unnest([y0, y0, y1, y1, y0]) as y from v_footprints) t")
def footprint_rings(spark, d):
    return spatial.vertex_rows(_fps(spark, d)).select("fp_id", "pos", r6("x").alias("x"), r6("y").alias("y"))


@query("select fp_id, fp_id % 3 = 1 as crossed, fp_id % 3 <> 2 as valid from v_footprints")
def quad_validity(spark, d):
    """A third of the footprints with two corners exchanged, a third collapsed to a line."""
    v = view(spark, d, "v_footprints")
    b = polygon.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    line = polygon.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0"))
    q = v.select("fp_id", F.when(F.col("fp_id") % 3 == 1, polygon.swap_middle(b)).when(F.col("fp_id") % 3 == 2, line).otherwise(b).alias("v"))
    crossed = polygon.self_crossing(F.col("v"))
    fixed = q.select("fp_id", crossed.alias("crossed"), F.when(crossed, polygon.swap_middle(F.col("v"))).otherwise(F.col("v")).alias("v"))
    return fixed.select("fp_id", "crossed", polygon.valid_quad(F.col("v")).alias("valid"))


@query("select ord, basename, stage from (select fp_id as ord, concat('e', cast(fp_id as string)) as basename, case when fp_id % 3 = 0 then '2a' else '2b' end as stage from v_footprints) t where stage = '2b'")
def stage_footprints(spark, d):
    """Footprints at the first stage that has one: rows of stage 2a have none."""
    f = _fps(spark, d)
    early = F.col("fp_id") % 3 == 0
    covers = f.select(F.col("fp_id").alias("ord"), F.concat(F.lit("e"), F.col("fp_id").cast("string")).alias("basename"), F.when(early, F.lit("2a")).otherwise(F.lit("2b")).alias("stage"), F.lit(0).alias("stage_no"), F.when(~early, F.col("vertices")).alias("vertices"))
    return boxes.stage_footprints(covers).select("ord", "basename", "stage")


@query("select fp_id as pair, round(2 * (x1 - x0) * (y1 - y0) - greatest(x1 - x0 - 3.5e-3, 0e0) * greatest(y1 - y0 - 3.5e-3, 0e0), 9) as area from v_footprints where floor(fp_id / 10) = floor((fp_id + 1) / 10) and fp_id + 1 in (select fp_id from v_footprints)")
def union_outlines(spark, d):
    """Area of each footprint and the next dither of its tile together."""
    f = _fps(spark, d)
    f = f.withColumn("pair", F.explode(F.array(F.col("fp_id") - 1, F.col("fp_id")))).where("floor(pair / 10) = floor((pair + 1) / 10)")
    two = f.join(f.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2"), "pair")
    return pointing.union_outline(two.select("pair", "vertices"), "pair").select("pair", F.round("area", 9).alias("area"))


@query()
def union_components(spark, d):
    """Area and centre of every component of overlapping footprints together: all footprints, unions of any size; tests do it by brute force."""
    f = _fps(spark, d)
    pairs = spatial.overlap_pairs(f).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = written(pointing.components_of(f.select("fp_id", "vertices"), pairs, "fp_id"), "groups", plain=True)
    n = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return pointing.union_outline(groups, "component").join(n, "component").select("component", "n", "area", "cx", "cy")


_MEMBERS = f"""m as (select regexp_extract(filename, '^jw\\d{{11}}_\\d{{5}}_\\d{{5}}', 0) as fileset, filter, detector, filename, exposure_id, concat(substr(filename, 1, 13), filter, substr(detector, 1, 4)) as grp from v_exposures)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    return _box(spark, d).withColumn("grp", F.concat(F.substring("filename", 1, 13), "filter", F.substring("detector", 1, 4)))


@query(f"with {_MEMBERS} select grp, concat(min(split_part(fileset, '_', 1)), '_', string_agg(distinct split_part(fileset, '_', 2), '+' order by split_part(fileset, '_', 2)), '_', min(filter), '_', min(lower(substr(detector, 1, 4)))) as name from m group by grp")
def product_names(spark, d):
    return pointing.product_name(_members(spark, d), "grp")


@query(f"with {_MEMBERS}, k as (select cast(floor(exposure_id / 8) as bigint) as g, string_agg(distinct fileset, ',' order by fileset) as filesets, min(substr(detector, 1, 4)) as module from m group by 1) select filesets, module, string_agg(cast(g as string), ',' order by g) as groups from k group by filesets, module")
def product_groups(spark, d):
    out = pointing.product_groups(_members(spark, d).withColumn("g", F.floor(F.col("exposure_id") / 8)), "g")
    return out.select(F.array_join("filesets", ",").alias("filesets"), "module", F.array_join(F.col("groups").cast("array<string>"), ",").alias("groups"))


@query(f"""with {_MEMBERS}, n as (select grp, concat(min(split_part(fileset, '_', 1)), '_', string_agg(distinct split_part(fileset, '_', 2), '+' order by split_part(fileset, '_', 2)), '_', min(filter), '_', min(lower(substr(detector, 1, 4)))) as name from m group by grp)
select m.grp, concat('{{"products":[{{"name":"', name, '","members":[', string_agg(concat('{{"expname":"', filename, '","exptype":"science"}}'), ',' order by filename), ']}}]}}') as json
from m join n on m.grp = n.grp group by m.grp, name""")
def association_files(spark, d):
    m = _members(spark, d)
    return pointing.associations(m.join(pointing.product_name(m, "grp"), "grp"), "grp")


# ---- pixels


def _px(spark: SparkSession, d: str) -> DataFrame:
    return written(view(spark, d, "v_pixels"), "pixels")


@query("""
with x as (select image_id, sci as v from v_pixels where sci is not null and dq = 0),
m as (select image_id, median(v) as m from x group by image_id),
s as (select x.image_id, median(abs(v - m)) * 1.482602218505602e0 as s from x join m on x.image_id = m.image_id group by x.image_id),
k as (select x.image_id, v from x join m on x.image_id = m.image_id join s on x.image_id = s.image_id where abs(v - m) <= 2e0 * s),
f as (select image_id, count(*) as n, avg(v) as mean, stddev_pop(v) as std, median(v) as med from k group by image_id)
select k.image_id, max(n) as n, round(max(mean), 6) as mean, round(max(std), 6) as std, round(max(med), 6) as median, round(median(abs(v - med)) * 1.482602218505602e0, 6) as mad
from k join f on k.image_id = f.image_id group by k.image_id""")
def clipped_stats(spark, d):
    s = stats.clipped_stats(_px(spark, d), mask=F.col("dq") != 0, sigma=2.0)
    return s.select("image_id", "n", r6("mean").alias("mean"), r6("std").alias("std"), r6("median").alias("median"), r6("mad").alias("mad"))


@query("""
with c as (select image_id, x, median(sci) as med from v_pixels where dq = 0 group by image_id, x),
b as (select image_id, floor(x / 4) as bin, median(med) as med from c group by image_id, floor(x / 4))
select c.image_id, c.x, round(b.med, 6) as med from c join b on c.image_id = b.image_id and floor(c.x / 4) = b.bin""")
def row_col_medians(spark, d):
    return stats.axis_medians(_px(spark, d), "x", good=F.col("dq") == 0, bin_size=4).select("image_id", "x", r6("med").alias("med"))


@query("""
with t as (select image_id, cast(floor(y / 8) as bigint) as ty, cast(floor(x / 8) as bigint) as tx, sum(case when dq <> 0 or sci is null then 1 else 0 end) as masked,
  median(case when dq = 0 then sci end) as med from v_pixels group by 1, 2, 3)
select image_id, ty, tx, round(med, 6) as med from t where masked <= 1e-1 * 64 and med is not null""")
def tile_medians(spark, d):
    return stats.tile_medians(_px(spark, d), F.col("dq") != 0, 8, fraction=0.1).select("image_id", "ty", "tx", r6("med").alias("med"))


@query("select image_id, max(x) + 1 as width, max(y) + 1 as height from v_pixels group by image_id")
def image_shapes(spark, d):
    """Sides of the images, which have to be multiples of the tile (64 x 1 here)."""
    return stats.divisible(_px(spark, d), 64, 1)


@query("select image_id, round(quantile_cont(sci, 0.01), 6) as p_low, round(quantile_cont(sci, 0.99), 6) as p_high from v_pixels where sci is not null group by image_id")
def image_percentiles(spark, d):
    return stats.percentiles(_px(spark, d)).select("image_id", r6("p_low").alias("p_low"), r6("p_high").alias("p_high"))


def _smooth_sql(tail: str) -> str:
    mirror = lambda i, n: f"(case when abs({i}) > {n} - 1 then 2 * {n} - 2 - abs({i}) else abs({i}) end)"
    return f"""
with b as (select image_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, median(sci) as med from v_pixels where sci is not null group by image_id),
p as (select p.image_id, y - y0 as y, x - x0 as x, coalesce(sci, 0e0) as num, case when sci is null then 0e0 else 1e0 end as den, x1 - x0 + 1 as w, y1 - y0 + 1 as h, x0, y0, med
  from v_pixels p join b on p.image_id = b.image_id where x between x0 and x1 and y between y0 and y1),
o as (select unnest(range(-15, 16)) as o),
k as (select o, exp(-o * o / 1.125e2) / (select sum(exp(-o * o / 1.125e2)) from o) as f from o),
c1 as (select p.image_id, p.y, p.x, sum(f * q.num) as num, sum(f * q.den) as den from p join k on true join p q on p.image_id = q.image_id and p.y = q.y and q.x = {mirror('p.x + o', 'p.w')} group by p.image_id, p.y, p.x),
c2 as (select p.image_id, p.y, p.x, sum(f * q.num) as num, sum(f * q.den) as den from p join k on true join c1 q on p.image_id = q.image_id and p.x = q.x and q.y = {mirror('p.y + o', 'p.h')} group by p.image_id, p.y, p.x),
s as (select p.image_id, p.y + p.y0 as y, p.x + p.x0 as x, case when c2.den > 1e-12 then c2.num / c2.den else med end as smooth from p join c2 on p.image_id = c2.image_id and p.y = c2.y and p.x = c2.x)
{tail}"""


@query(_smooth_sql("select v.image_id, v.y, v.x, round(smooth, 6) as smooth from v_pixels v left join s on v.image_id = s.image_id and v.y = s.y and v.x = s.x"))
def smooth_plane(spark, d):
    return pixels.smooth(_px(spark, d)).select("image_id", "y", "x", r6("smooth").alias("smooth"))


@query(_smooth_sql("select v.image_id, v.y, v.x, round(case when dq <> 0 and x_in then smooth else sci end, 6) as filled from (select v.*, v.x between x0 and x1 and v.y between y0 and y1 as x_in from v_pixels v join b on v.image_id = b.image_id) v left join s on v.image_id = s.image_id and v.y = s.y and v.x = s.x"))
def fill_masked(spark, d):
    p = _px(spark, d)
    model = pixels.smooth(p).withColumnRenamed("smooth", "model")
    return pixels.fill_masked(p, model, F.col("dq") != 0).select("image_id", "y", "x", r6("filled").alias("filled"))


_NOISE = """
with g as (select image_id, y, x, sci from v_pixels where dq = 0 and sci is not null),
m as (select image_id, median(sci) as med from g group by image_id),
r as (select g.image_id, y, x, sci - med as v from g join m on g.image_id = m.image_id),
c as (select image_id, x, median(v) as c from r group by image_id, x),
q as (select r.image_id, y, median(v - c) as q from r join c on r.image_id = c.image_id and r.x = c.x group by r.image_id, y),
n as (select p.image_id, p.y, p.x, p.sci, coalesce(c, 0e0) + coalesce(q, 0e0) as noise from v_pixels p left join c on p.image_id = c.image_id and p.x = c.x left join q on p.image_id = q.image_id and p.y = q.y)
"""


@query(_NOISE + "select image_id, y, x, round(noise, 6) as noise from n")
def stripe_noise(spark, d):
    return pixels.stripe_noise(_px(spark, d), F.col("dq") != 0).select("image_id", "y", "x", r6("noise").alias("noise"))


@query(_NOISE + "select image_id, y, x, round(sci - noise, 6) as sci from n")
def subtract_noise(spark, d):
    p = _px(spark, d)
    return pixels.subtract(p, pixels.stripe_noise(p, F.col("dq") != 0), "noise").select("image_id", "y", "x", r6("sci").alias("sci"))


@query("with q as (select image_id, quantile_cont(sci, 0.01) as lo, quantile_cont(sci, 0.99) as hi from v_pixels where sci is not null group by image_id) select p.image_id, y, x, round(case when dq <> 0 then hi else lo end, 6) as shown from v_pixels p join q on p.image_id = q.image_id")
def mask_plane(spark, d):
    return pixels.mask_plane(_px(spark, d), F.col("dq") != 0).select("image_id", "y", "x", r6("shown").alias("shown"))


@query("""
with /*recursive*/ v as (select image_id, y, x, sci as v from v_pixels where sci is not null),
a as (select image_id, median(v) as m from v group by image_id),
b as (select v.*, abs(v - m) as d from v join a on v.image_id = a.image_id),
s as (select image_id, median(d) * 1.482602218505602e0 as s from b group by image_id),
k as (select b.* from b join s on b.image_id = s.image_id where d <= 3 * s),
m as (select image_id, median(v) as m from k group by image_id),
q as (select k.image_id, any_value(m) as m, median(abs(v - m)) * 1.482602218505602e0 as mad from k join m on k.image_id = m.image_id group by k.image_id),
bright as (select v.image_id, y, x from v join q on v.image_id = q.image_id where v - m > mad),
near as (select a.image_id, a.y, a.x, b.y as ny, b.x as nx from bright a join bright b on a.image_id = b.image_id and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1),
reach as (select image_id, y, x, y as ry, x as rx from bright union select r.image_id, r.y, r.x, ny, nx from reach r join near n on r.image_id = n.image_id and r.ry = n.y and r.rx = n.x),
large as (select image_id, y, x from reach group by image_id, y, x having count(*) >= 4),
f as (select p.image_id, p.y, p.x, case when l.y is null then 0e0 else 1e0 end as on_ from v_pixels p left join large l on p.image_id = l.image_id and p.y = l.y and p.x = l.x),
z as (select image_id, max(y) + 1 as h, max(x) + 1 as w from v_pixels group by image_id),
o as (select unnest(range(-4, 5)) as o),
g as (select o, exp(-o * o / 8e0) / (select sum(exp(-o * o / 8e0)) from o) as g from o),
c1 as (select f.image_id, f.y, f.x, sum(g * t.on_) as s from f join z on f.image_id = z.image_id join g on true join f t on t.image_id = f.image_id and t.y = f.y and t.x = (case when abs(f.x + o) > w - 1 then 2 * w - 2 - abs(f.x + o) else abs(f.x + o) end) group by f.image_id, f.y, f.x),
c2 as (select f.image_id, f.y, f.x, sum(g * t.s) as s from f join z on f.image_id = z.image_id join g on true join c1 t on t.image_id = f.image_id and t.x = f.x and t.y = (case when abs(f.y + o) > h - 1 then 2 * h - 2 - abs(f.y + o) else abs(f.y + o) end) group by f.image_id, f.y, f.x)
select image_id, y, x, s > 5e-2 as segment from c2""")
def segmentation(spark, d):
    return pixels.segmentation(_px(spark, d), factor=1.0, min_pixels=4)


@query()
def stripe_noise_full(spark, d):
    return pixels.stripe_noise_full(_px(spark, d), bin_size=4)


@query()
def background(spark, d):
    return pixels.background(_px(spark, d), F.col("dq") != 0, 8)


# ---- spectra


def _spec(spark: SparkSession, d: str) -> DataFrame:
    return written(view(spark, d, "v_spectra"), "spectra")


_EDGES = """
e as (select *, coalesce((lag(wavelength) over w + wavelength) / 2, wavelength - (lead(wavelength) over w - wavelength) / 2) as lo,
  coalesce((lead(wavelength) over w + wavelength) / 2, wavelength + (wavelength - lag(wavelength) over w) / 2) as hi from v_spectra window w as (partition by spec_id, y order by wavelength))
"""
_GRID = """
d as (select distinct spec_id, wavelength from v_spectra),
st as (select median(s) as step from (select wavelength - lag(wavelength) over (partition by spec_id order by wavelength) as s from d) t where s is not null),
g as (select min(wavelength) as g0, max(wavelength) as g1, max(step) as step, cast(floor((max(wavelength) - min(wavelength)) / max(step)) + 1 as bigint) as n from d, st)
"""
_RES = f"""{_EDGES}, {_GRID},
bins as (select unnest(range(0, n)) as bin, g0, step from g),
o as (select spec_id, y, bin, flux, err, (least(hi, g0 + (bin + 5e-1) * step) - greatest(lo, g0 + (bin - 5e-1) * step)) / step as part from e join bins on hi > g0 + (bin - 5e-1) * step and lo < g0 + (bin + 5e-1) * step),
rs as (select spec_id, y, bin, sum(case when err > 0 then flux * part end) as flux, sqrt(sum(case when err > 0 then power(err * part, 2) end)) as err from o where part > 0 group by spec_id, y, bin)
"""


@query(f"with {_EDGES} select spec_id, y, x, round(lo, 6) as lo, round(hi, 6) as hi from e")
def wave_edges(spark, d):
    s = _spec(spark, d).withColumn("line", F.struct("spec_id", "y"))
    return spectra.edges(s, "line").select("spec_id", "y", "x", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(f"with {_GRID} select unnest(range(0, n)) as bin, round(g0 + unnest(range(0, n)) * step, 6) as center from g")
def wave_grid(spark, d):
    return spectra.grid(_spec(spark, d).select("spec_id", "wavelength").distinct()).select("bin", r6("center").alias("center"))


def _resampled(spark: SparkSession, d: str) -> DataFrame:
    s = _spec(spark, d)
    return spectra.resample(s, spectra.grid_parameters(s.select("spec_id", "wavelength").distinct()))


@query(f"with {_RES} select spec_id, y, bin, round(flux, 6) as flux, round(err, 6) as err from rs")
def resample(spark, d):
    return _resampled(spark, d).select("spec_id", "y", "bin", r6("flux").alias("flux"), r6("err").alias("err"))


_MEAN = """
w1 as (select y, bin, sum(flux / power(err, 2)) / sum(1 / power(err, 2)) as m from rs group by y, bin),
w2 as (select rs.y, rs.bin, sqrt(sum(power(flux - m, 2) / power(err, 2)) / sum(1 / power(err, 2))) as s from rs join w1 on rs.y = w1.y and rs.bin = w1.bin group by rs.y, rs.bin),
mean as (select rs.y, rs.bin, sum(flux / power(err, 2)) / sum(1 / power(err, 2)) as flux, sqrt(1 / sum(1 / power(err, 2))) as err, count(*) as n
from rs join w1 on rs.y = w1.y and rs.bin = w1.bin join w2 on rs.y = w2.y and rs.bin = w2.bin where abs(flux - m) <= 3 * s group by rs.y, rs.bin)
"""


@query(f"with {_RES}, {_MEAN} select y, bin, round(flux, 6) as flux, round(err, 6) as err, n from mean")
def combine_mean(spark, d):
    return spectra.combine_mean(_resampled(spark, d)).select("y", "bin", r6("flux").alias("flux"), r6("err").alias("err"), "n")


@query(f"with {_RES}, m as (select y, bin, median(flux) as m, count(flux) as n from rs group by y, bin) select rs.y, rs.bin, round(max(m), 6) as flux, round(median(abs(flux - m)) * 1.4826e0 / sqrt(max(n)), 6) as err, max(n) as n from rs join m on rs.y = m.y and rs.bin = m.bin group by rs.y, rs.bin")
def combine_median(spark, d):
    return spectra.combine_median(_resampled(spark, d)).select("y", "bin", r6("flux").alias("flux"), r6("err").alias("err"), "n")


@query(f"with {_RES}, {_MEAN} select y, bin, round(g0 + bin * step, 6) as center, round(flux, 6) as flux, round(err, 6) as err, mean.n from mean, g")
def resample_and_combine(spark, d):
    return spectra.resample_and_combine(_spec(spark, d)).select("y", "bin", r6("center").alias("center"), r6("flux").alias("flux"), r6("err").alias("err"), "n")


_TRACE = "t as (select distinct image_id, image_id * 10 + 1 as source_id, x, 1e1 + x * 2.5e-1 as y_trace, 3.8e0 + x * 1e-2 as wavelength from v_pixels)"


def _trace(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return p.select("image_id", (F.col("image_id") * 10 + 1).alias("source_id"), "x", (10.0 + x * 0.25).alias("y_trace"), (3.8 + x * 0.01).alias("wavelength")).distinct()


@query(f"with {_TRACE}, r as (select *, unnest([0, 1, 2, 3, 4]) as row from t) select r.image_id, source_id, r.x, row, round(wavelength, 6) as wavelength, round(sci, 6) as flux, round(err, 6) as err from r left join v_pixels p on p.image_id = r.image_id and p.x = r.x and p.y = cast(round_even(y_trace, 0) as bigint) - 2 + row")
def cutout(spark, d):
    p = _px(spark, d)
    return spectra.cutout(p, _trace(p), 5).select("image_id", "source_id", "x", "row", r6("wavelength").alias("wavelength"), r6("flux").alias("flux"), r6("err").alias("err"))


# ---- sky coordinates

_WCS = {"crpix1": 32.5, "crpix2": 20.5, "cd11": -1e-4, "cd12": 2e-5, "cd21": 2e-5, "cd22": 1e-4}


def _wcs(p: DataFrame) -> DataFrame:
    w = p.select("image_id").distinct()
    for k, v in _WCS.items():
        w = w.withColumn(k, F.lit(v))
    return w.withColumns({"crval1": 10.0 + F.col("image_id") * 0.1, "crval2": -5.0 + F.col("image_id") * 0.2, "width": F.lit(64).cast("long"), "height": F.lit(40).cast("long")})


_SKY = """
u as (select image_id, y, x, x + 1 - 3.25e1 as u, y + 1 - 2.05e1 as v, 1e1 + image_id * 1e-1 as a0, -5e0 + image_id * 2e-1 as d0 from v_pixels),
p as (select *, radians(-1e-4 * u + 2e-5 * v) as xi, radians(2e-5 * u + 1e-4 * v) as eta from u),
s as (select image_id, y, x, a0 + degrees(atan2(xi, cos(radians(d0)) - eta * sin(radians(d0)))) as ra,
  degrees(atan2(sin(radians(d0)) + eta * cos(radians(d0)), sqrt(xi * xi + power(cos(radians(d0)) - eta * sin(radians(d0)), 2)))) as dec, d0, a0 from p)
"""


@query(f"with {_SKY} select image_id, y, x, round(ra, 6) as ra, round(dec, 6) as dec from s")
def pixel_coordinates(spark, d):
    p = _px(spark, d)
    return wcs.pixel_coordinates(p, _wcs(p)).select("image_id", "y", "x", r6("ra").alias("ra"), r6("dec").alias("dec"))


@query("select image_id, y, x, round(cast(x as double), 6) as pix_x, round(cast(y as double), 6) as pix_y from v_pixels")
def sky_to_pixel(spark, d):
    """Sky positions of all pixels, back on the detector."""
    p = _px(spark, d)
    s = wcs.pixel_coordinates(p, _wcs(p)).join(_wcs(p), "image_id").withColumn("p", wcs.sky_to_pixel(F.col("ra"), F.col("dec")))
    return s.select("image_id", "y", "x", r6("p.pix_x").alias("pix_x"), r6("p.pix_y").alias("pix_y"))


@query("""
with i as (select distinct image_id from v_pixels), c as (select image_id, unnest([0, 1, 2, 3]) as corner, unnest([0, 63, 63, 0]) as px, unnest([0, 0, 39, 39]) as py from i),
u as (select *, px + 1 - 3.25e1 as u, py + 1 - 2.05e1 as v, 1e1 + image_id * 1e-1 as a0, radians(-5e0 + image_id * 2e-1) as d0 from c),
p as (select *, radians(-1e-4 * u + 2e-5 * v) as xi, radians(2e-5 * u + 1e-4 * v) as eta from u)
select image_id, corner, cast(px as bigint) as px, cast(py as bigint) as py, round(a0 + degrees(atan2(xi, cos(d0) - eta * sin(d0))), 6) as ra,
  round(degrees(atan2(sin(d0) + eta * cos(d0), sqrt(xi * xi + power(cos(d0) - eta * sin(d0), 2)))), 6) as dec from p""")
def wcs_footprints(spark, d):
    f = wcs.footprints(_wcs(_px(spark, d))).select("image_id", F.posexplode(F.arrays_zip("vertices", "vertex_marker")).alias("corner", "c"))
    return f.select("image_id", "corner", F.col("c.vertex_marker")[0].alias("px"), F.col("c.vertex_marker")[1].alias("py"), r6("c.vertices.x").alias("ra"), r6("c.vertices.y").alias("dec"))


@query("""
with i as (select distinct image_id, 1e1 + image_id * 1e-1 as a0, radians(-5e0 + image_id * 2e-1) as d0 from v_pixels),
s as (select id, ra, dec, image_id, radians(ra - a0) as a, radians(dec) as d, d0 from v_catalog join i on abs(ra - a0) < 1e-1 and abs(dec - degrees(d0)) < 1e-1),
t as (select *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a) as c from s),
x as (select id, ra, dec, image_id, degrees(cos(d) * sin(a) / c) as xi, degrees((cos(d0) * sin(d) - sin(d0) * cos(d) * cos(a)) / c) as eta from t),
p as (select id, ra, dec, image_id, (1e-4 * xi - 2e-5 * eta) / (-1e-4 * 1e-4 - 2e-5 * 2e-5) + 3.15e1 as pix_x, (-1e-4 * eta - 2e-5 * xi) / (-1e-4 * 1e-4 - 2e-5 * 2e-5) + 1.95e1 as pix_y from x)
select id, ra, dec, image_id, round(pix_x, 4) as pix_x, round(pix_y, 4) as pix_y from p where pix_x > 0 and pix_x < 63 and pix_y > 0 and pix_y < 39""")
def catalog_pixels(spark, d):
    w = _wcs(_px(spark, d))
    out = wcs.catalog_pixels(view(spark, d, "v_catalog"), wcs.footprints(w), w)
    return out.select("id", "ra", "dec", "image_id", F.round("pix_x", 4).alias("pix_x"), F.round("pix_y", 4).alias("pix_y"))


def _fields(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All images as grism fields of the two modules in turn, and as direct images of three filters, the third without a partner nearby."""
    w = _wcs(p)
    module = F.when(F.col("image_id") % 2 == 0, "NRCALONG").otherwise("NRCBLONG")
    images = wcs.footprints(w).withColumn("filter", F.concat(F.lit("F"), (F.col("image_id") % 3).cast("string"))).withColumn("pupil", F.lit("CLEAR"))
    return w.withColumn("detector", module), images


@query()
def counterparts(spark, d):
    """Direct images that overlap the extended field of each image, by filter; tests hold it against a brute-force version."""
    return wcs.counterparts(*_fields(_px(spark, d)))


@query()
def counterpart_planes(spark, d):
    """The values of those images on the fields' grids with their whole extension, by tile: places with a value, their sum, the first and last places.

    Tests hold it against a brute-force version."""
    p = _px(spark, d)
    grism, images = _fields(p)
    planes = wcs.counterpart_planes(grism, images, _wcs(p), p, missing=False)
    tile = [F.floor(F.col(c) / tiles.SIDE).alias(n) for c, n in (("oy", "tile_y"), ("ox", "tile_x"))]
    return planes.groupBy("target", "filter", "image_id", *tile).agg(F.count("value").alias("n"), r6(F.sum("value")).alias("total"), F.min(F.struct("oy", "ox")).alias("first"), F.max(F.struct("oy", "ox")).alias("last"))


@query("""
with m as (select image_id, max(x) as mx, max(y) as my from v_pixels group by image_id),
t as (select p.image_id, y as oy, x as ox, x * 9e-1 + y * 5e-2 + 3e-1 as in_x, y * 9.5e-1 - x * 2e-2 + 1e-1 as in_y, mx, my from v_pixels p join m on p.image_id = m.image_id),
i as (select * from t where in_x between 0 and mx and in_y between 0 and my),
n as (select *, cast(floor(in_x) as bigint) + a as nx, cast(floor(in_y) as bigint) + b as ny,
  (case when a = 1 then in_x - floor(in_x) else 1 - in_x + floor(in_x) end) * (case when b = 1 then in_y - floor(in_y) else 1 - in_y + floor(in_y) end) as w
  from i, (select unnest([0, 1]) as a) aa, (select unnest([0, 1]) as b) bb),
v as (select n.image_id, oy, ox, sum(w * sci) / sum(w) as value from n join v_pixels p on n.image_id = p.image_id and nx = p.x and ny = p.y where w > 0 and sci is not null group by n.image_id, oy, ox)
select t.image_id, t.oy, t.ox, round(value, 6) as value from t left join v on t.image_id = v.image_id and t.oy = v.oy and t.ox = v.ox""")
def reproject_bilinear(spark, d):
    p = _px(spark, d)
    x, y = F.col("x"), F.col("y")
    t = p.select("image_id", y.alias("oy"), x.alias("ox"), (x * 0.9 + y * 0.05 + 0.3).alias("in_x"), (y * 0.95 - x * 0.02 + 0.1).alias("in_y"))
    return wcs.reproject(p, t).select("image_id", "oy", "ox", r6("value").alias("value"))


def _sky_sql(x: str, y: str, rows: str) -> str:
    """``rows`` (with image_id) and the sky position of their pixel (x, y)."""
    return f"""(select *, a0 + degrees(atan2(xi, cos(d0) - eta * sin(d0))) as ra, degrees(atan2(sin(d0) + eta * cos(d0), sqrt(xi * xi + power(cos(d0) - eta * sin(d0), 2)))) as dec
  from (select *, radians(-1e-4 * ({x} - 3.15e1) + 2e-5 * ({y} - 1.95e1)) as xi, radians(2e-5 * ({x} - 3.15e1) + 1e-4 * ({y} - 1.95e1)) as eta, 1e1 + image_id * 1e-1 as a0, radians(-5e0 + image_id * 2e-1) as d0 from {rows}) q)"""


@query(f"""
with t as (select distinct image_id, image_id * 10 + 1 as source_id, x, 1e1 + x * 2.5e-1 as y_trace, 3.8e0 + x * 1e-2 as wavelength from v_pixels where x between 2 and 61),
k as (select image_id, corner, ra, dec from {_sky_sql("px", "py", "(select image_id, unnest([0, 1, 2, 3]) as corner, unnest([0, 63, 63, 0]) as px, unnest([0, 0, 39, 39]) as py from (select distinct image_id from v_pixels) i) c")} k),
e as (select a.image_id, a.corner, a.ra as x0, a.dec as y0, b.ra as x1, b.dec as y1, o.ra as ox, o.dec as oy from k a join k b on a.image_id = b.image_id and b.corner = (a.corner + 1) % 4 join k o on a.image_id = o.image_id and o.corner = 0),
w as (select *, (x0 - ox) * (y1 - oy) - (x1 - ox) * (y0 - oy) as c from e),
f as (select image_id, min(ox) + sum((x0 + x1 - 2 * ox) * c) / (3 * sum(c)) as cx, min(oy) + sum((y0 + y1 - 2 * oy) * c) / (3 * sum(c)) as cy, sign(sum(c)) as turn from w group by image_id),
g as (select id, ra, dec from v_catalog where cast(floor(id / 10) as bigint) % 100 = 0),
n as (select id, image_id from (select id, ra, dec, image_id, row_number() over (partition by id, ra, dec order by power(cx - ra, 2) + power(cy - dec, 2), image_id) as r from (select distinct id, ra, dec from g) g, f) x where r = 1),
z as (select image_id, x, ra as sx, dec as sy from {_sky_sql("x", "y_trace", "t")} z where x in (2, 61)),
h as (select distinct n.id, c.image_id from (select distinct id, image_id from n) n join z on n.image_id = z.image_id, (
  select w.image_id, x0, y0, x1, y1, turn from w join f on w.image_id = f.image_id) c group by n.id, z.x, z.image_id, c.image_id having bool_and(turn * ((x1 - x0) * (sy - y0) - (y1 - y0) * (sx - x0)) > 0)),
r as (select id, t.*, unnest([0, 1, 2, 3, 4]) as row from t join h on t.image_id = h.image_id)
select id, r.image_id, source_id, r.x, row, cast(row_number() over (partition by id, r.image_id, source_id, row order by wavelength, r.x) - 1 as integer) as wave_no,
  round(wavelength, 6) as wavelength, round(sci, 6) as flux, round(err, 6) as err
from r left join v_pixels p on p.image_id = r.image_id and p.x = r.x and p.y = cast(round_even(y_trace, 0) as bigint) - 2 + row""")
def extract_spectra(spark, d):
    """Cut-outs of the sources of every hundredth order, over all grism exposures that hold an end of the spectrum in their nearest exposure."""
    p = _px(spark, d)
    w = _wcs(p)
    exposures = wcs.footprints(w).select(F.col("image_id").alias("ord"), "image_id", F.lit("GRISMR").alias("pupil"), "vertices")
    # ends inside the image: the first and last column lie on the footprint's sides
    trace = _trace(p).where("x between 2 and 61").join(w, "image_id").withColumn("s", wcs.pixel_to_sky(F.col("x").cast("double"), F.col("y_trace")))
    trace = trace.select("image_id", "source_id", "x", "y_trace", "wavelength", F.col("s.ra").alias("sx"), F.col("s.dec").alias("sy"))
    out = spectra.extract(exposures, p, trace, view(spark, d, "v_catalog").where("floor(id / 10) % 100 = 0"), 5)
    return out.select("id", "image_id", "source_id", "x", "row", "wave_no", r6("wavelength").alias("wavelength"), r6("flux").alias("flux"), r6("err").alias("err"))


@query(_smooth_sql("""select v.image_id, v.y, v.x, round(coalesce(smooth, a), 6) as smooth from v_pixels v join (select image_id, avg(sci) as a from v_pixels group by image_id) m on v.image_id = m.image_id
left join s on v.image_id = s.image_id and v.y = s.y and v.x = s.x""").replace("from v_pixels", "from w").replace("\nwith ", "\nwith w as (select image_id, y, x, case when x >= 4 and y >= 3 then sci end as sci from v_pixels),\n", 1))
def outer_fill(spark, d):
    """Smoothed planes whose data leave columns and rows free at two sides, filled there with the image's mean."""
    p = _px(spark, d).withColumn("sci", F.when((F.col("x") >= 4) & (F.col("y") >= 3), F.col("sci")))
    return pixels.smooth(p, fill="mean").select("image_id", "y", "x", r6("smooth").alias("smooth"))


@query(f"with k as (select distinct {_BASE} as basename from v_exposures), n as (select exposure_id, filename, {_BASE} as base from v_exposures where exposure_id % 10 = 0), a as (select exposure_id, unnest([filename, base, 'no_' || base]) as name from n) select exposure_id, name, name in (select basename from k) as found from a")
def contains_keys(spark, d):
    """Whether the names of files, of their exposures, and made-up names are keys of the box."""
    box = _box(spark, d)
    asked = box.where("exposure_id % 10 = 0").select("exposure_id", F.explode(F.array("filename", "basename", F.concat(F.lit("no_"), "basename"))).alias("name"))
    return boxes.held(box, asked).select("exposure_id", "name", "found")


@query()
def random_target(spark, d):
    """The one exposure that stands for a target when none is given."""
    return boxes.random_target(_box(spark, d).select("basename", "filename")).select("basename", "filename")


def _checked_product(product: dict) -> None:
    """The work on one product: its name must end as its suffix says, and products of stage 1b are refused."""
    if not product["filename"].endswith(product["file_suffix"] + ".fits"):
        raise ValueError("name and suffix differ")
    if product["category"] == "1b":
        raise RuntimeError("stage 1b is not reduced")


@query("select case when category = '1b' then 'failed' else 'ok' end as status, case when category = '1b' then 'RuntimeError: stage 1b is not reduced' end as error, count(*) as n from v_products group by all")
def batch_outcomes(spark, d):
    """Work on every product, with an outcome instead of a failure of the job, counted by outcome."""
    done = jobs.run(view(spark, d, "v_products"), _checked_product, "filename")
    return done.groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
