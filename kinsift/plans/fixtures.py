"""Views over the standard tables that stand for catalogues; each text runs in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOC_FILES = """
select doc_id as file_id,
  concat('/', lang, '/', source, case when doc_id % 7 = 0 then '/downloads' else '' end, '/d', cast(cast(floor(doc_id / 400) as bigint) as string), '/doc ', cast(doc_id % 400 as string),
    case when doc_id % 5 = 0 then ' (1)' when doc_id % 5 = 1 then ' - copy' else '' end, '.txt') as path,
  n_chars as size, 1700000000 + doc_id * 60 as mtime_s, '.txt' as ext, text as content
from documents
"""

TRACKS = """
select cast(p_partkey as bigint) as file_id,
  concat('/music/', p_brand, case when p_partkey % 11 = 0 then '/temp' else '' end, '/d', cast(cast(floor(p_partkey / 700) as bigint) as string), '/track ', cast(p_partkey % 700 as string),
    case when p_partkey % 6 = 0 then ' (2)' else '' end, case when p_partkey % 8 = 0 then '.flac' else '.mp3' end) as path,
  cast(65536 + (p_partkey * 7919) % 900000 as bigint) as size, cast(1700000000 + p_partkey * 60 as bigint) as mtime_s,
  case when p_partkey % 9 = 0 then '' when p_size % 4 = 0 then concat(p_brand, ' & ', p_type) else p_brand end as artist,
  case when p_partkey % 13 = 0 then '' when p_size % 4 = 0 then concat(p_name, ' (feat. ', p_type, ')') when p_size % 4 = 1 then concat(p_name, ' Ft. ', p_type) else p_name end as title,
  case when p_size % 3 = 0 then '' else p_type end as album,
  cast((64 + 64 * (p_size % 5)) * 1000 as bigint) as bitrate, cast(p_partkey % 4000 as double) / 10 as duration
from part
"""

OLD_SIGNATURES = """
select doc_id as file_id, n_chars as size, 1700000000 + doc_id * 60 + case when doc_id % 10 = 1 then 5 else 0 end as mtime_s, 19000 + doc_id % 200 as seen_day
from documents where doc_id % 3 <> 0
"""

DURATIONS = "select event_id as file_id, value as duration from events"

SIZES = "select cast(o_orderkey as bigint) as file_id, cast(floor(o_totalprice) as bigint) as size, case when o_orderkey % 3 = 0 then 'audio' else 'other' end as category from orders"

DATES = "select cast(o_orderkey as bigint) as file_id, cast(o_orderdate as date) as d from orders"

VIEWS = {"doc_files": (DOC_FILES, "documents"), "tracks": (TRACKS, "part"), "old_signatures": (OLD_SIGNATURES, "documents"), "durations": (DURATIONS, "events"), "sizes": (SIZES, "orders"), "dates": (DATES, "orders")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, table = VIEWS[name]
    return spark.sql(text.replace(f"from {table}", f"from {{{table}}}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def with_views(*names: str) -> str:
    """The beginning of a DuckDB query that uses views."""
    return "with recursive " + ", ".join(f"{n} as ({VIEWS[n][0]})" for n in names)
