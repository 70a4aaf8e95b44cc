"""Sources, keyed tables and the incremental harvest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.fixed import ABSTRACT_URL
from ...operators.vectors import hashed_encoder
from ...session import scratch_path, shuffles_end
from ...sources import files, tables
from ...sources.records import project_record, read_records, valid_records
from ...streaming.ingest import harvest, ingest
from ..stages import CorpusStages
from .base import embeddings, papers, query, seeds, table
from .gating import EXACT, FALLBACK, PATTERNS, PREFIXES

ORDER = ["ts", "event_id"]


def _events(spark, sf):
    return table(spark, sf, "events")


def _order():
    return [F.col(c) for c in ORDER]


_LATEST = """SELECT * FROM events {where}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
_EVENT_PARTS = f"""WITH target AS ({_LATEST.format(where="WHERE event_type <> 'click'")}),
source AS ({_LATEST.format(where="WHERE event_type = 'click'")})"""


@query("latest_per_key", _LATEST.format(where=""))
def latest_per_key(spark, sf):
    return tables.latest_per_key(_events(spark, sf), ["user_id"], _order())


def _target(spark, sf):
    rows = _events(spark, sf).where("event_type <> 'click'")
    return tables.latest_per_key(rows, ["user_id"], _order())


def _clicks(spark, sf):
    return _events(spark, sf).where("event_type = 'click'")


@query(
    "upsert_full",
    f"""{_EVENT_PARTS} SELECT * FROM source UNION ALL
    SELECT * FROM target WHERE user_id NOT IN (SELECT user_id FROM source)""",
)
def upsert_full(spark, sf):
    return tables.upsert(_target(spark, sf), _clicks(spark, sf), ["user_id"], order_by=_order())


@query(
    "upsert_repeats",
    f"""WITH target AS ({_LATEST.format(where="WHERE event_type <> 'click'")}),
    source AS (SELECT * FROM events WHERE event_type = 'click'
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT * FROM source UNION ALL
    SELECT * FROM target WHERE user_id NOT IN (SELECT user_id FROM source)""",
)
def upsert_repeats(spark, sf):
    """Repeated source keys and no order: still one row a key."""
    return tables.upsert(_target(spark, sf), _clicks(spark, sf), ["user_id"])


@query(
    "upsert_partial",
    f"""{_EVENT_PARTS} SELECT coalesce(t.event_id, s.event_id) AS event_id,
      coalesce(s.ts, t.ts) AS ts, coalesce(t.user_id, s.user_id) AS user_id,
      coalesce(t.event_type, s.event_type) AS event_type, coalesce(s.value, t.value) AS value,
      coalesce(t.props, s.props) AS props
    FROM target t FULL JOIN source s USING (user_id)""",
)
def upsert_partial(spark, sf):
    return tables.upsert(
        _target(spark, sf), _clicks(spark, sf), ["user_id"], ["ts", "value"], _order()
    )


@query(
    "upsert_prune",
    f"""{_EVENT_PARTS} SELECT * FROM source""",
)
def upsert_prune(spark, sf):
    return tables.upsert(
        _target(spark, sf), _clicks(spark, sf), ["user_id"], order_by=_order(), prune=True
    )


@query(
    "embedding_upsert",
    """SELECT coalesce(e.vec_id, d.doc_id) AS paper_id,
      CASE WHEN d.doc_id IS NULL THEN 'old' ELSE 'new' END AS model,
      CASE WHEN d.doc_id IS NULL THEN 64 ELSE 2 END AS dim,
      CASE WHEN e.vec_id IS NULL THEN 2 ELSE 1 END AS created
    FROM embeddings e FULL JOIN labels d ON d.doc_id = e.vec_id""",
)
def embedding_upsert(spark, sf):
    target = embeddings(spark, sf).select(
        "paper_id", F.lit("old").alias("model"), F.size("vector").alias("dim"), "vector",
        F.lit(1).alias("created"),
    )
    source = table(spark, sf, "labels").select(
        F.col("doc_id").alias("paper_id"),
        F.lit("new").alias("model"),
        F.lit(2).alias("dim"),
        F.array(F.col("quality"), F.col("toxic")).cast("array<float>").alias("vector"),
        F.lit(2).alias("created"),
    )
    rows = tables.upsert(target, source, ["paper_id"], ["model", "dim", "vector"])
    return rows.select("paper_id", "model", "dim", "created")


@query(
    "label_upsert",
    """WITH old AS (SELECT 'default' AS method, p_size AS cluster_id, min(p_name) AS label FROM part
      WHERE p_type <> 'ECONOMY' GROUP BY p_size),
    new AS (SELECT CASE WHEN p_size < 25 THEN 'default' ELSE 'other' END AS method, p_size AS cluster_id,
      max(p_brand) AS label FROM part WHERE p_type = 'ECONOMY' GROUP BY p_size)
    SELECT method, cluster_id, coalesce(new.label, old.label) AS label,
      CASE WHEN old.label IS NULL THEN 2 ELSE 1 END AS created
    FROM old FULL JOIN new USING (method, cluster_id)""",
)
def label_upsert(spark, sf):
    part = table(spark, sf, "part")
    old = part.where("p_type <> 'ECONOMY'").groupBy(
        F.lit("default").alias("method"), F.col("p_size").alias("cluster_id")
    )
    method = F.when(F.col("p_size") < 25, "default").otherwise("other")
    new = part.where("p_type = 'ECONOMY'").groupBy(
        method.alias("method"), F.col("p_size").alias("cluster_id")
    )
    return tables.upsert(
        old.agg(F.min("p_name").alias("label"), F.lit(1).alias("created")),
        new.agg(F.max("p_brand").alias("label"), F.lit(2).alias("created")),
        ["method", "cluster_id"],
        ["label"],
    )


@query(
    "bucket_table",
    f"""{_EVENT_PARTS} SELECT user_id, event_id FROM source UNION ALL
    SELECT user_id, event_id FROM target WHERE user_id NOT IN (SELECT user_id FROM source)""",
)
def bucket_table(spark, sf):
    """The same merge by parts of the table."""
    kept = tables.BucketTable(spark, scratch_path(spark, "events"), "user_id long, event_id long", ["user_id"], 8)
    kept.upsert(_target(spark, sf))
    return kept.upsert(tables.latest_per_key(_clicks(spark, sf), ["user_id"], _order()))


@query(
    "snapshot_table",
    f"""{_EVENT_PARTS} SELECT user_id, event_id FROM source UNION ALL
    SELECT user_id, event_id FROM target WHERE user_id NOT IN (SELECT user_id FROM source)""",
)
def snapshot_table(spark, sf):
    """Two batches written as versions of one table."""
    kept = tables.SnapshotTable(spark, scratch_path(spark, "events"), "user_id long, event_id long")
    kept.replace(_target(spark, sf))
    latest = tables.latest_per_key(_clicks(spark, sf), ["user_id"], _order())
    return kept.upsert(latest, ["user_id"])


@query(
    "ensure_columns",
    "SELECT n_nationkey, n_name, n_regionkey, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS INTEGER) AS flag FROM nation",
)
def ensure_columns(spark, sf):
    return tables.ensure_columns(
        table(spark, sf, "nation"), "n_nationkey int, n_name string, tag string, flag int"
    )


@query(
    "union_sets",
    """SELECT user_id, event_id, ts FROM (
      SELECT *, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS s FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, ts DESC, event_id DESC) = 1""",
)
def union_sets(spark, sf):
    ev = _events(spark, sf)
    kind = F.col("event_type")
    sets = [ev.where(~kind.isin("click", "view")), ev.where(kind == "view"), ev.where(kind == "click")]
    return tables.union_sets(sets, ["user_id"], _order()).select("user_id", "event_id", "ts")


@query(
    "integrity_audit",
    "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
)
def integrity_audit(spark, sf):
    rows = tables.audit_integrity(
        table(spark, sf, "embeddings"), table(spark, sf, "labels"), "vec_id", "doc_id"
    )
    return rows.select("vec_id")


@query(
    "cascade",
    "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)",
)
def cascade(spark, sf):
    rows = tables.cascade(papers(spark, sf), embeddings(spark, sf), "id", "paper_id")
    return rows.select("id")


@query(
    "read_table",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_returnflag = 'R'",
)
def read_table(spark, sf):
    where = (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (
        F.col("l_returnflag") == "R"
    )
    columns = ["l_orderkey", "l_linenumber", "l_quantity"]
    return tables.read_table(spark, f"{sf}/lineitem.parquet", columns, where)


@query("read_ids", "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE toxic = 1")
def read_ids(spark, sf):
    """Seeds written as a text list with repeats, blanks and padding, then read back."""
    path = scratch_path(spark, "seeds")
    ids = seeds(spark, sf).select(F.col("id").cast("string").alias("value"))
    padded = ids.select(F.concat(F.lit("  "), "value", F.lit("\t")).alias("value"))
    blank = ids.select(F.lit("   ").alias("value"))
    ids.union(padded).union(blank).write.text(path)
    return files.read_ids(spark, path)


@query("read_labels", "SELECT CAST(doc_id AS VARCHAR) AS id, quality AS label FROM labels")
def read_labels(spark, sf):
    path = scratch_path(spark, "labels")
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    rows.write.option("header", True).csv(path)
    return files.read_labels(spark, path)


def _write_pages(rows, path, per_page):
    """Records as XML pages, evenly dealt: 8, or more where a page would hold over ``per_page``.

    A page is one XML document and is read by one task, so pages must not grow with the table. They
    land compressed, as plain XML takes some twenty times the room.
    """
    pages = rows.repartition(max(8, -(-rows.count() // per_page)))
    with shuffles_end(rows.sparkSession):
        pages.write.format("xml").options(rowTag="record", rootTag="ListRecords", compression="gzip").save(path)
    return path


def _landed(spark, sf, path=None, title="Order\n for ", where="true"):
    """Orders as harvested records: half-finished ones deleted, some names incomplete."""
    path = path or scratch_path(spark, "landing")
    author = F.struct(
        F.concat(F.lit("Clerk "), "o_custkey").alias("keyname"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("forenames"),
    )
    body = F.struct(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string"))
        .otherwise(" ").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"),
        F.concat(F.lit(title), "o_custkey").alias("title"),
        F.concat(F.lit("  <Total> & "), F.col("o_totalprice").cast("string")).alias("abstract"),
        F.concat(F.lit("cs."), "o_orderstatus").alias("categories"),
        F.struct(F.array(author, author).alias("author")).alias("authors"),
    )
    header = F.struct(
        F.when(F.col("o_orderpriority") == "5-LOW", "deleted").alias("_status"),
        F.concat(F.lit("oai:"), "o_orderkey").alias("identifier"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("datestamp"),
    )
    rows = table(spark, sf, "orders").where(where).select(
        header.alias("header"), F.struct(body.alias("arXiv")).alias("metadata")
    )
    return _write_pages(rows, path, 50_000)


_RECORDS = """SELECT 'https://arxiv.org/abs/' || o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS published,
  'Order' || chr(10) || ' for ' || o_custkey AS title,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Clerk ' || o_custkey || ', Clerk ' || o_custkey
    ELSE o_orderpriority || ' Clerk ' || o_custkey || ', ' || o_orderpriority || ' Clerk ' || o_custkey END AS authors,
  'cs.' || o_orderstatus AS categories, 'https://arxiv.org/pdf/' || o_orderkey || '.pdf' AS pdf_url
FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'"""
_FIELDS = ["id", "published", "title", "authors", "categories", "pdf_url"]


@query("harvest_records", _RECORDS)
def harvest_records(spark, sf):
    """Orders written as XML pages, read back as records, filtered and flattened."""
    records = read_records(spark, _landed(spark, sf))
    return project_record(valid_records(records)).select(*_FIELDS)


@query(
    "ingest",
    _RECORDS + " AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31'",
)
def ingest_stream(spark, sf):
    """The same pages through the resumable stream into a table, twice; nothing doubles."""
    landing, target = _landed(spark, sf), scratch_path(spark, "papers_raw")
    checkpoint = scratch_path(spark, "harvest")
    for _ in range(2):
        rows = ingest(spark, landing, target, checkpoint, "1995-01-01", "1999-12-31")
    return rows.select(*_FIELDS)


@query("ingest_window", _RECORDS)
def ingest_window(spark, sf):
    """A run bounded by a date, then one without bounds over the same pages: nothing is missed."""
    landing, target = _landed(spark, sf), scratch_path(spark, "papers_raw")
    checkpoint = scratch_path(spark, "harvest")
    ingest(spark, landing, target, checkpoint, until_date="1996-12-31")
    return ingest(spark, landing, target, checkpoint).select(*_FIELDS)


_VALID = "o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'"


@query(
    "harvest_counts",
    f"""WITH o AS (SELECT *, {_VALID} AS ok, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
    SELECT 1 AS run, '1990-01-01' AS from_date, '1996-12-31' AS until_date, count(*) AS scanned,
      count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE ok AND day <= '1996-12-31') AS saved,
      count(*) FILTER (WHERE ok AND day > '1996-12-31') AS waiting FROM o
    UNION ALL SELECT 2, '1996-12-31', '1997-12-31', 0, 0,
      count(*) FILTER (WHERE ok AND day > '1996-12-31' AND day <= '1997-12-31'),
      count(*) FILTER (WHERE ok AND day > '1997-12-31') FROM o""",
)
def harvest_counts(spark, sf):
    """Windows and counts of two runs: the second goes on where the first ended, without new pages."""
    paths = [_landed(spark, sf), scratch_path(spark, "papers_raw"), scratch_path(spark, "harvest")]
    first = harvest(spark, *paths, until_date="1996-12-31", first_day="1990-01-01")
    return first.unionByName(harvest(spark, *paths, until_date="1997-12-31"))


@query(
    "harvest_sets",
    f"""SELECT 'https://arxiv.org/abs/' || o_orderkey AS id, o_orderpriority = '1-URGENT' AS second_run,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'Again' WHEN o_custkey % 3 = 0 THEN 'Econ'
        WHEN o_custkey % 2 = 0 THEN 'Stat' ELSE 'Cs' END || ' for ' || o_custkey AS title
    FROM orders WHERE {_VALID}""",
)
def harvest_sets(spark, sf):
    """Orders listed in up to three sets, the last of which counts, and some harvested again."""
    landing, target, state = (scratch_path(spark, n) for n in ("landing", "papers_raw", "harvest"))
    for name, where in (("econ", "o_custkey % 3 = 0"), ("cs", "true"), ("stat", "o_custkey % 2 = 0")):
        _landed(spark, sf, f"{landing}/{name}", f"{name.title()} for ", where)
    harvest(spark, landing, target, state, "1990-01-01", "2005-12-31")
    _landed(spark, sf, f"{landing}/again/cs", "Again for ", "o_orderpriority = '1-URGENT'")
    rows = ingest(spark, landing, target, state, "1990-01-01", "2005-12-31")
    return rows.select("id", F.col("title").startswith("Again").alias("second_run"), "title")


@query("all_stages")
def all_stages(spark, sf):
    """Documents as harvested pages, through every stage to labelled clusters."""
    landing, root = scratch_path(spark, "landing"), scratch_path(spark, "stages")
    docs = papers(spark, sf)
    body = F.struct(
        F.col("id").cast("string").alias("id"),
        F.col("published").alias("created"),
        "title",
        F.col("summary").alias("abstract"),
        "categories",
    )
    header = F.struct(F.concat(F.lit("oai:"), "id").alias("identifier"), F.col("published").alias("datestamp"))
    pages = docs.select(header.alias("header"), F.struct(body.alias("arXiv")).alias("metadata"))
    _write_pages(pages, landing, 10_000)
    stages = CorpusStages(spark, root, hashed_encoder(64))
    stages.harvest(landing)
    stages.stage1(patterns=PATTERNS, fallback=FALLBACK, exact=EXACT, prefixes=PREFIXES)
    stages.embed()
    named = F.concat(F.lit(ABSTRACT_URL), F.col("id").cast("string"))
    stages.filter(seeds(spark, sf).select(named.alias("id")), tau=0.2)
    stages.cluster(kmeans=4, agg=4)
    stages.label(ngram_range=(1, 2), cosine_floor=0.1)
    stages.export_graph(f"{root}/graph", min_sim=0.6)
    return stages.labels.read().select("method", "cluster_id", "label", "confidence")
