"""Views of the driver's tables in the shapes that the operators take (FIXTURES.md), for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_exposures": """
select event_id as exposure_id, ts,
  concat('jw', lpad(cast(user_id as string), 5, '0'), '001001_',
         lpad(cast(cast(floor(event_id / 100) as bigint) as string), 5, '0'), '_',
         lpad(cast(event_id % 100 as string), 5, '0'), '_',
         case event_id % 4 when 0 then 'nrca1' when 1 then 'nrcalong' when 2 then 'nrcb1' else 'nrcblong' end,
         case when event_type = 'error' then '_rate.fits' else '_cal.fits' end) as filename,
  case event_type when 'click' then 'F115W' when 'view' then 'F200W' when 'purchase' then 'F356W'
                  when 'signup' then 'F444W' else 'F090W' end as filter,
  case event_id % 4 when 0 then 'NRCA1' when 1 then 'NRCALONG' when 2 then 'NRCB1' else 'NRCBLONG' end as detector,
  case event_type when 'purchase' then 'GRISMR' when 'signup' then 'GRISMC' else 'CLEAR' end as pupil,
  case when event_type = 'error' then '2a' else '2b' end as stage
from events
""",
    "v_footprints": """
select fp_id, filter, cx - 2e-2 as x0, cy - 2e-2 as y0, cx + 2e-2 as x1, cy + 2e-2 as y1
from (select c_custkey as fp_id, c_mktsegment as filter,
        10e0 + (cast(floor(c_custkey / 10) as bigint) % 40) * 1e-1 + (c_custkey % 10) * 3.5e-3 as cx,
        -5e0 + cast(floor(c_custkey / 400) as bigint) * 1e-1 + (c_custkey % 10) * 3.5e-3 as cy
      from customer) t
""",
    "v_catalog": """
select l_orderkey * 10 + l_linenumber as id,
  10e0 + (l_partkey % 400) * 1e-2 + l_discount * 3e-2 as ra,
  -5e0 + (l_suppkey % 40) * 1e-2 + l_tax * 3e-2 as dec
from lineitem
""",
    "v_pixels": """
select label as image_id, cast(y as bigint) as y, cast(pos as bigint) as x,
  case when (vec_id + pos) % 17 = 0 then null else cast(v as double) end as sci,
  5e-2 + 1e-2 * (vec_id % 5) as err,
  case when (vec_id * 7 + pos * 13) % 11 = 0 then 1 else 0 end as dq
from v_flat
""",
    "v_spectra": """
select cast(y as bigint) as spec_id, label as y, cast(pos as bigint) as x,
  38e-1 + 1e-2 * pos + 7e-4 * (y % 7) as wavelength,
  cast(v as double) as flux, 5e-2 + 1e-2 * (vec_id % 5) as err
from v_flat
""",
    "v_search_results": """
select o_orderkey as fileset,
  case o_orderstatus when 'F' then 'public' when 'O' then 'restricted' else 'private' end as access
from orders
""",
    "v_products": """
select l_orderkey as dataset,
  concat('d', cast(l_orderkey as string), case when l_partkey % 5 = 0 then '_rateints'
         when l_partkey % 5 = 1 then '_rate' else '_cal' end, '.fits') as filename,
  case l_returnflag when 'A' then 'NIRCAM' when 'N' then 'NIRSPEC' else 'MIRI' end as instrument_name,
  case l_linenumber % 4 when 0 then '1b' when 1 then '2a' when 2 then '2b' else '2c' end as category,
  case when l_partkey % 5 = 0 then '_rateints' when l_partkey % 5 = 1 then '_rate' else '_cal' end as file_suffix,
  cast(floor(l_extendedprice) as bigint) as size
from lineitem
""",
}
FLAT_SPARK = """
select label, vec_id, y, pos, v from (
  select label, vec_id, y, posexplode(embedding) as (pos, v) from (
    select label, vec_id, embedding,
      row_number() over (partition by label order by vec_id) - 1 as y from embeddings) a) b
"""
FLAT_DUCKDB = """
select label, vec_id, y, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as v from (
  select label, vec_id, embedding,
    row_number() over (partition by label order by vec_id) - 1 as y from embeddings) a
"""

TABLES = {"v_exposures": "events", "v_footprints": "customer", "v_catalog": "lineitem", "v_pixels": "embeddings", "v_spectra": "embeddings", "v_search_results": "orders", "v_products": "lineitem"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture view ``name`` over the tables in ``sf_dir``."""
    text, table = VIEWS[name], TABLES[name]
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"lf_{table}")
    flat = FLAT_SPARK.replace("from embeddings", "from lf_embeddings")
    text = text.replace("from v_flat", f"from ({flat}) v_flat").replace(f"from {table}", f"from lf_{table}")
    return spark.sql(text)


def oracle(body: str) -> str:
    """``body`` with the views that it names in front."""
    used = [n for n in VIEWS if n in body]
    parts = [f"{n} as ({VIEWS[n].strip()})" for n in used]
    if any("v_flat" in VIEWS[n] for n in used):
        parts.insert(0, f"v_flat as ({FLAT_DUCKDB.strip()})")
    recursive = "recursive " if "/*recursive*/" in body else ""
    rest = body.strip()
    if not parts:
        return rest
    if rest.startswith("with "):
        return f"with {recursive}{', '.join(parts)}, {rest[5:]}"
    return f"with {recursive}{', '.join(parts)} {rest}"
