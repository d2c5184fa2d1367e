"""The registered queries of the engine's own operators and their DuckDB SQL.

Each query runs through the engine: parsed, planned over its store, and given
back as a DataFrame. Queries that write do so in a fresh store in the folder
that driver and executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .engine import Engine, QueryResult, answer, encode
from .functions.distance import squared_l2
from .functions.text import with_vector_text
from .operators import ivf
from .sources.files import shared_folder
from .sources.log import LOG
from .streaming.follower import Follower

CENTS = "CAST(ROUND(o_totalprice * 100) AS BIGINT)"


def fresh_engine(spark: SparkSession) -> Engine:
    return Engine(spark, f"{shared_folder(spark)}/quarry/db-{uuid.uuid4().hex}")


def _engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    db = fresh_engine(spark)
    for t in tables:
        db.register_parquet(t, f"{sf_dir}/{t}.parquet")
    return db


def _loaded(spark: SparkSession, sf_dir: str, table: str, columns: str, where: str = "true", *, source: str = "orders", select: str) -> Engine:
    """A store with a table of its own, filled from a Parquet table in one transaction."""
    db = fresh_engine(spark)
    db.sql(f"CREATE TABLE {table} ({columns})")
    txn = db.begin()
    db.load(table, spark.read.parquet(f"{sf_dir}/{source}.parquet").where(where).selectExpr(*select.split("; ")), txn)
    db.commit(txn)
    return db


def _named(result: QueryResult, *names: str) -> DataFrame:
    return result.dataframe.toDF(*names)


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _statement(name: str, table: str, text: str, oracle: str | None = None, names: tuple[str, ...] = ()) -> None:
    """A query of one statement over one registered table; its own text is the oracle's unless another is given."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = _engine(spark, sf_dir, table).sql(text)
        return _named(result, *names) if names else result.dataframe

    _register(name, query, text if oracle is None else oracle)


# Scans, projection, filters

_statement("q_scan_star", "nation", "SELECT * FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
_statement("q_project", "orders", "SELECT o_orderkey, o_custkey FROM orders")
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _statement(f"q_{_name}", "orders", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {_op} 100")
_statement("q_filter_conj", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 100 AND o_custkey <= 200 AND o_orderstatus != 'F'")
_statement("q_text_lt", "customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'FURNITURE'")

# Aggregates

_statement("q_count_star", "lineitem", "SELECT COUNT(*) FROM lineitem", "SELECT COUNT(*) AS n FROM lineitem", ("n",))
_statement("q_count_col", "lineitem", "SELECT COUNT(l_partkey) FROM lineitem", "SELECT COUNT(l_partkey) AS n FROM lineitem", ("n",))
_statement("q_sum", "lineitem", "SELECT SUM(l_linenumber) FROM lineitem", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem", ("total",))
_statement("q_avg_text", "lineitem", "SELECT AVG(l_linenumber) FROM lineitem", "SELECT printf('%.4f', SUM(l_linenumber)::DOUBLE / COUNT(*)) AS mean FROM lineitem", ("mean",))
_statement("q_min", "lineitem", "SELECT MIN(l_orderkey) FROM lineitem", "SELECT MIN(l_orderkey) AS least FROM lineitem", ("least",))
_statement("q_max", "lineitem", "SELECT MAX(l_orderkey) FROM lineitem", "SELECT MAX(l_orderkey) AS most FROM lineitem", ("most",))
_SOME = "WHERE l_orderkey > 1000 AND l_linenumber <= 3"
for _name, _what, _sql in (
    ("count", "COUNT(*)", "COUNT(*)"), ("sum", "SUM(l_partkey)", "CAST(SUM(l_partkey) AS BIGINT)"), ("min", "MIN(l_partkey)", "MIN(l_partkey)"),
    ("max", "MAX(l_partkey)", "MAX(l_partkey)"), ("avg", "AVG(l_partkey)", "printf('%.4f', SUM(l_partkey)::DOUBLE / COUNT(*))"),
):
    _statement(f"q_agg_filtered_{_name}", "lineitem", f"SELECT {_what} FROM lineitem {_SOME}", f"SELECT {_sql} AS value FROM lineitem {_SOME}", ("value",))


def _group_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's tables are ordinary DataFrames to Spark: what the dialect lacks is a step away."""
    rows = _engine(spark, sf_dir, "lineitem").dataframe("lineitem")
    return rows.groupBy("l_returnflag").agg((F.sum("l_linenumber").cast("double") / F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("n"))


_register("q_avg_ratio", _group_ratio, "SELECT l_returnflag, CAST(SUM(l_linenumber) AS DOUBLE) / COUNT(*) AS mean, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")


# Columnar snapshots

def _columnar_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _engine(spark, sf_dir, "lineitem")
    db.sql("REFRESH COLUMNAR lineitem")
    return _named(db.sql("SELECT SUM(l_partkey) FROM lineitem"), "total")


def _columnar_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "o", "k INT, cents INT", "o_orderkey % 2 = 0", select=f"o_orderkey AS k; {CENTS} AS cents")
    db.sql("REFRESH COLUMNAR o")
    txn = db.begin()
    db.load("o", spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 1").selectExpr("o_orderkey AS k", f"{CENTS} AS cents"), txn)
    db.commit(txn)
    stale = db.sql("SELECT SUM(cents) FROM o").rows[0][0]
    db.sql("REFRESH COLUMNAR o")
    return spark.createDataFrame([(stale, db.sql("SELECT SUM(cents) FROM o").rows[0][0])], "stale long, fresh long")


_register("q_columnar_sum", _columnar_sum, "SELECT CAST(SUM(l_partkey) AS BIGINT) AS total FROM lineitem")
_register("q_columnar_stale", _columnar_stale, f"""
    SELECT CAST(SUM(CASE WHEN o_orderkey % 2 = 0 THEN {CENTS} END) AS BIGINT) AS stale, CAST(SUM({CENTS}) AS BIGINT) AS fresh FROM orders""")


# Secondary indexes

def _indexed(spark: SparkSession, sf_dir: str) -> Engine:
    db = _loaded(spark, sf_dir, "l", "k INT, p INT, n INT", source="lineitem", select="l_orderkey AS k; l_partkey AS p; CAST(l_linenumber AS BIGINT) AS n")
    db.sql("CREATE INDEX by_key ON l (k)")
    return db


_register("q_index_lookup", lambda s, d: _indexed(s, d).sql("SELECT k, p, n FROM l WHERE k = 25").dataframe,
          "SELECT l_orderkey AS k, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey = 25")
_register("q_index_residual", lambda s, d: _indexed(s, d).sql("SELECT k, n FROM l WHERE n >= 2 AND k = 25 AND p > 10").dataframe,
          "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey = 25 AND l_linenumber >= 2 AND l_partkey > 10")
_register("q_range_scan", lambda s, d: _indexed(s, d).between("by_key", 100, 200),
          "SELECT l_orderkey AS k, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200")
_register("q_index_lookup_many", lambda s, d: _indexed(s, d).lookup_many("by_key", s.read.parquet(f"{d}/orders.parquet").select("o_orderkey")),
          "SELECT l_orderkey AS k, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")


def _index_after_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made on an empty table, which grows with it."""
    db = fresh_engine(spark)
    db.sql("CREATE TABLE l (k INT, p INT, n INT)")
    db.sql("CREATE INDEX by_key ON l (k)")
    txn = db.begin()
    db.load("l", spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS k", "l_partkey AS p", "CAST(l_linenumber AS BIGINT) AS n"), txn)
    db.commit(txn)
    db.compact("l")
    return db.sql("SELECT k, p, n FROM l WHERE k = 25").dataframe


def _index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after an insert, a delete and another insert."""
    db = _indexed(spark, sf_dir)
    db.sql("INSERT INTO l VALUES (25, -1, 9)")
    db.sql("DELETE FROM l WHERE k = 25 AND n = 1")
    db.sql("INSERT INTO l VALUES (25, -2, 1)")
    return db.sql("SELECT k, p, n FROM l WHERE k = 25").dataframe


_LINES = "SELECT l_orderkey AS k, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey = 25"
_register("q_index_after_growth", _index_after_growth, _LINES)
_register("q_index_upkeep", _index_upkeep, f"{_LINES} AND l_linenumber <> 1 UNION ALL SELECT 25, -1, 9 UNION ALL SELECT 25, -2, 1")


# Writes and versions

def _orders(spark: SparkSession, sf_dir: str) -> Engine:
    return _loaded(spark, sf_dir, "o", "k INT, c INT, status TEXT", select="o_orderkey AS k; o_custkey AS c; o_orderstatus AS status")


def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _orders(spark, sf_dir)
    db.executemany([f"INSERT INTO o VALUES (-{i}, {i}, 'new')" for i in range(1, 6)])
    return db.sql("SELECT k, c, status FROM o").dataframe


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _orders(spark, sf_dir)
    db.sql("DELETE FROM o WHERE c > 100 AND status = 'F'")
    return db.sql("SELECT k, c, status FROM o").dataframe


def _delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_orders(spark, sf_dir).sql("DELETE FROM o WHERE c > 100 AND status = 'F'").rows_affected,)], "n long")


def _versions(spark: SparkSession, sf_dir: str, own: bool) -> DataFrame:
    """An open transaction with inserts and deletes, seen by itself or by others; another was aborted."""
    db = _orders(spark, sf_dir)
    gone = db.begin()
    db.execute("DELETE FROM o WHERE c < 50", gone)
    db.abort(gone)
    txn = db.begin()
    db.execute("DELETE FROM o WHERE status = 'O'", txn)
    db.execute("INSERT INTO o VALUES (-1, -1, 'mine')", txn)
    return db.execute("SELECT k, c, status FROM o", txn if own else None).dataframe


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _orders(spark, sf_dir)
    db.sql("DELETE FROM o WHERE status = 'P'")
    db.compact("o")
    return db.sql("SELECT k, c, status FROM o").dataframe


_ORDERS = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS status FROM orders"
_register("q_insert", _insert, f"{_ORDERS} UNION ALL SELECT -i, i, 'new' FROM range(1, 6) t(i)")
_register("q_delete", _delete, f"{_ORDERS} WHERE NOT (o_custkey > 100 AND o_orderstatus = 'F')")
_register("q_delete_count", _delete_count, "SELECT COUNT(*) AS n FROM orders WHERE o_custkey > 100 AND o_orderstatus = 'F'")
_register("q_txn_fresh", lambda s, d: _versions(s, d, False), _ORDERS)
_register("q_txn_own", lambda s, d: _versions(s, d, True), f"{_ORDERS} WHERE o_orderstatus <> 'O' UNION ALL SELECT -1, -1, 'mine'")
_register("q_compact", _compacted, f"{_ORDERS} WHERE o_orderstatus <> 'P'")


def _mvcc(spark: SparkSession, sf_dir: str, reader: int) -> DataFrame:
    """The store's visibility rule: rows made by transactions 1 to 7 and taken by 1 to 11, of which some committed and one may be the reader's."""
    db = fresh_engine(spark)
    db.sql("CREATE TABLE o (k INT, maker INT, taker INT)")
    table = db.store.state.table("o")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey AS k", "o_orderkey % 7 + 1 AS maker", "CASE WHEN o_custkey % 5 = 0 THEN o_custkey % 11 + 1 ELSE 0L END AS taker",
    )
    made = db.store.write(rows.select("*", F.col("maker").alias("_xmin"), F.monotonically_increasing_id().alias("_seq"), F.col("maker").alias("by")), "t/o/data/all", "by")
    taken = db.store.read(made, table.schema.struct()).where("taker <> 0").select("_xmin", "_seq", F.col("taker").alias("by"))
    taken = db.store.write(taken, "t/o/tomb/all", "by")
    of = lambda paths, txn: [p for p in paths if f"/by={txn}/" in p]
    for txn in (1, 2, 4, 6, 8, 10):
        db.store.publish("COMMIT", txn, {"tables": {"o": {"data": of(made, txn), "tombs": of(taken, txn)}}})
    own = db.store.read(of(made, reader), table.schema.struct()) if reader else None
    return db.store.snapshot(table, own, of(taken, reader)).select(F.col("k").alias("o_orderkey"), F.col("maker").alias("xmin"), F.col("taker").alias("xmax"))


_MVCC = """
WITH v AS (SELECT o_orderkey, CAST(o_orderkey % 7 + 1 AS BIGINT) AS xmin,
   CAST(CASE WHEN o_custkey % 5 = 0 THEN o_custkey % 11 + 1 ELSE 0 END AS BIGINT) AS xmax FROM orders),
 committed AS (SELECT CAST(x AS BIGINT) AS txn FROM (VALUES (1),(2),(4),(6),(8),(10)) t(x))
SELECT o_orderkey, xmin, xmax FROM v
WHERE (xmin = {r} OR xmin IN (SELECT txn FROM committed))
  AND NOT (xmax <> 0 AND (xmax = {r} OR xmax IN (SELECT txn FROM committed)))"""
_register("q_mvcc_fresh", lambda s, d: _mvcc(s, d, 0), _MVCC.format(r=0))
_register("q_mvcc_own", lambda s, d: _mvcc(s, d, 3), _MVCC.format(r=3))


# The log

_REDO = "SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id > 500 GROUP BY user_id"


def _tear(db: Engine) -> None:
    """Leave half a record after the last one, as a crash would on a file system that shows files while they are written."""
    db.store.files.publish(f"{LOG}/{db.store.log.lsn + 1:020d}.json", '{"lsn": ')


def _images(spark: SparkSession, sf_dir: str) -> tuple[Engine, list]:
    """A table of each user's last value, and what commits the events after number 500 to it, in two parts."""
    db = fresh_engine(spark)
    db.sql("CREATE TABLE image (user_id INT, lsn INT, value TEXT)")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("event_id")).first()[0] or 500
    middle = (500 + last) // 2

    def put(to: Engine, low: int, high: int) -> None:
        part = events.where((F.col("event_id") > low) & (F.col("event_id") <= high))
        newest = part.groupBy("user_id").agg(F.max("event_id").alias("lsn"), F.max_by("value", "event_id").cast("string").alias("value"))
        txn = to.begin()
        to.replace("image", newest, "user_id", txn)
        to.commit(txn)

    return db, [lambda to: put(to, 500, middle), lambda to: put(to, middle, last)]


def _image_rows(db: Engine) -> DataFrame:
    return db.sql("SELECT user_id, value FROM image").dataframe.select("user_id", F.col("value").cast("double").alias("value"))


def _wal_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last values after a crash: the log is read anew, in part from a checkpoint, without a torn record and what was not committed."""
    db, (first, second) = _images(spark, sf_dir)
    first(db)
    db.store.checkpoint()
    second(db)
    lost = db.begin()
    db.execute("DELETE FROM image", lost)
    _tear(db)
    return _image_rows(Engine(spark, db.store.files.root))


def _log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a follower that tails the log as a stream."""
    db, parts = _images(spark, sf_dir)
    follower = Follower(spark, db.store.files.root, f"{db.store.files.root}-offsets")
    for part in parts:
        part(db)
        follower.catch_up()
    return _image_rows(follower.engine)


_register("q_wal_redo", _wal_redo, _REDO)
_register("q_log_tail", _log_tail, _REDO)


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that was left with a torn record takes writes again."""
    db = _orders(spark, sf_dir)
    _tear(db)
    again = Engine(spark, db.store.files.root)
    again.sql("INSERT INTO o VALUES (-1, 1, 'late')")
    return Engine(spark, db.store.files.root, write=False).sql("SELECT k, c, status FROM o").dataframe


def _at_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at an earlier number of the log."""
    db = _orders(spark, sf_dir)
    db.sql("DELETE FROM o WHERE status = 'P'")
    then = db.store.log.lsn
    db.sql("DELETE FROM o WHERE status = 'F'")
    db.compact("o")
    return Engine(spark, db.store.files.root, at=then).sql("SELECT k, c, status FROM o").dataframe


def _replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A follower's view after catching up with a load, a delete and an insert, with a restart between."""
    db = _orders(spark, sf_dir)
    root = db.store.files.root
    Follower(spark, root, f"{root}-offsets").catch_up()
    db.sql("DELETE FROM o WHERE status = 'F'")
    follower = Follower(spark, root, f"{root}-offsets")
    follower.catch_up()
    db.sql("INSERT INTO o VALUES (-1, 1, 'late')")
    follower.catch_up()
    return follower.engine.sql("SELECT k, c, status FROM o").dataframe


_register("q_recovered", _recovered, f"{_ORDERS} UNION ALL SELECT -1, 1, 'late'")
_register("q_at_lsn", _at_lsn, f"{_ORDERS} WHERE o_orderstatus <> 'P'")
_register("q_replica", _replica, f"{_ORDERS} WHERE o_orderstatus <> 'F' UNION ALL SELECT -1, 1, 'late'")


# Vectors

def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").first()["embedding"])


def _vectors(spark: SparkSession, sf_dir: str, lists: int = 4) -> Engine:
    db = _engine(spark, sf_dir, "embeddings")
    db.sql(f"CREATE VECTOR INDEX i ON embeddings (embedding) LISTS {lists}")
    return db


def _label_means(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda z: z.m).alias("c")
    )
    return [r["c"] for r in means.orderBy("label").collect()]  # one row per label


_MEANS = """
 x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
 m AS (SELECT label, pos, avg(v) AS v FROM x GROUP BY ALL),
 cent AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS cid, list(v ORDER BY pos) AS c FROM m GROUP BY label),
 far AS (SELECT e.vec_id, cid, list_sum(list_transform(list_zip(e.embedding, c), lambda p: (p[1]::DOUBLE-p[2])*(p[1]::DOUBLE-p[2]))) AS d
         FROM embeddings e CROSS JOIN cent),
 own AS (SELECT vec_id, cid FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) AS n FROM far) WHERE n = 1)"""


def _ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _engine(spark, sf_dir, "embeddings").dataframe("embeddings").select("vec_id", "embedding")
    return ivf.assign(rows, "embedding", _label_means(spark, sf_dir)).select("vec_id", F.col("_cluster").alias("cid"))


def _given_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _engine(spark, sf_dir, "embeddings")
    db.create_vector_index("i", "embeddings", "embedding", centroids=_label_means(spark, sf_dir))
    return db.search("i", _first_vector(spark, sf_dir), 10, 4).select("vec_id")


_register("q_ivf_assign", _ivf_assign, f"WITH {_MEANS.lstrip()} SELECT vec_id, cid FROM own")
_register("q_ivf_given_centroids", _given_centroids, f"""
WITH {_MEANS.lstrip()},
 q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
 probed AS (SELECT cid FROM far WHERE vec_id = 0 ORDER BY d, cid LIMIT 4),
 c AS (SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.v), lambda p: (p[1]::DOUBLE-p[2]::DOUBLE)*(p[1]::DOUBLE-p[2]::DOUBLE))) AS dist
       FROM embeddings e JOIN own USING (vec_id) JOIN probed USING (cid) CROSS JOIN q)
SELECT vec_id FROM c ORDER BY dist, vec_id LIMIT 10""")


def _filed(spark: SparkSession, sf_dir: str) -> Engine:
    """The embeddings filed under ten centroids, of which a search by SQL opens four."""
    db = _engine(spark, sf_dir, "embeddings")
    db.create_vector_index("i", "embeddings", "embedding", centroids=_label_means(spark, sf_dir))
    return db


def _near_first(spark: SparkSession, sf_dir: str, db: Engine, table: str, where: str = "") -> DataFrame:
    first = _first_vector(spark, sf_dir)
    near = db.sql(f"SELECT vec_id, embedding FROM {table} {where} ORDER BY embedding <-> [{','.join(f'{x:.17f}' for x in first)}] LIMIT 5")
    # The dialect keeps the order but shows no rank; it is told from the distance.
    dist = squared_l2(F.col("embedding"), F.array(*[F.lit(x) for x in first]))
    return near.dataframe.select("vec_id", F.row_number().over(Window.orderBy(dist, "vec_id")).cast("long").alias("rk"))


def _knn_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector index over rows that came after it and without rows that went."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    db = fresh_engine(spark)
    db.sql(f"CREATE TABLE e (vec_id INT, embedding VECTOR({len(_first_vector(spark, sf_dir))}))")
    for part in ("vec_id % 2 = 0", "vec_id % 2 = 1"):
        txn = db.begin()
        db.load("e", rows.where(part), txn)
        db.commit(txn)
        if part.endswith("0"):
            db.create_vector_index("i", "e", "embedding", centroids=_label_means(spark, sf_dir))
    db.sql("DELETE FROM e WHERE vec_id > 100 AND vec_id < 200")
    return _near_first(spark, sf_dir, db, "e")


_GAP = "list_sum(list_transform(list_zip(e.embedding, {q}), lambda p: (p[1]::DOUBLE-p[2]::DOUBLE)*(p[1]::DOUBLE-p[2]::DOUBLE)))"
_KNN = f"""
WITH {_MEANS.lstrip()},
 q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
 probed AS (SELECT cid FROM far WHERE vec_id = 0 ORDER BY d, cid LIMIT 4),
 c AS (SELECT e.vec_id, e.label, {_GAP.format(q="q.v")} AS dist FROM embeddings e JOIN own USING (vec_id) JOIN probed USING (cid) CROSS JOIN q WHERE {{before}}),
 r AS (SELECT *, row_number() OVER (ORDER BY dist, vec_id) AS rn FROM c),
 f AS (SELECT *, row_number() OVER (ORDER BY rn) AS rk FROM r WHERE rn <= 20 {{where}})
SELECT vec_id, CAST(rk AS BIGINT) AS rk FROM f WHERE rk <= 5"""
_register("q_knn", lambda s, d: _near_first(s, d, _filed(s, d), "embeddings"), _KNN.format(where="", before="true"))
_register("q_hybrid", lambda s, d: _near_first(s, d, _filed(s, d), "embeddings", "WHERE label < 4"), _KNN.format(where="AND label < 4", before="true"))
_register("q_hybrid_range", lambda s, d: _near_first(s, d, _filed(s, d), "embeddings", "WHERE vec_id > 200"), _KNN.format(where="AND vec_id > 200", before="true"))
_register("q_knn_upkeep", _knn_upkeep, _KNN.format(where="", before="NOT (e.vec_id > 100 AND e.vec_id < 200)"))


def _knn_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list is probed, so the batch is exact."""
    asked = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _vectors(spark, sf_dir).search_many("i", asked, 5, 4).select("query_id", "rank", "vec_id")


_register("q_knn_many", _knn_many, """
WITH c AS (SELECT q.vec_id AS query_id, e.vec_id,
       list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE-p[2]::DOUBLE)*(p[1]::DOUBLE-p[2]::DOUBLE))) AS dist
     FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM c) WHERE rank <= 5""")


def recall(spark: SparkSession, sf_dir: str, db: Engine, lists: int) -> DataFrame:
    """Mean recall at 10 by number of probed lists."""
    asked = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = db.search_many("i", asked, 10, lists).select("query_id", "vec_id").cache()
    of, found = exact.count(), None
    for nprobe in (1, 2, 4, 8, lists):
        hits = db.search_many("i", asked, 10, nprobe).select("query_id", "vec_id").join(exact, ["query_id", "vec_id"], "left_semi")
        one = hits.agg(F.lit(nprobe).alias("nprobe"), (F.count(F.lit(1)) / F.lit(max(1, of))).alias("recall"))
        found = one if found is None else found.unionByName(one)
    return found


_register("q_recall", lambda s, d: recall(s, d, _filed(s, d), 10), f"""
WITH {_MEANS.lstrip()},
 asked AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 10 = 0),
 c AS (SELECT query_id, e.vec_id, cid, {_GAP.format(q="asked.v")} AS dist FROM embeddings e JOIN own USING (vec_id) CROSS JOIN asked),
 exact AS (SELECT query_id, vec_id, 1 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS n FROM c) WHERE n <= 10),
 probed AS (SELECT vec_id AS query_id, cid, row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) AS place FROM far WHERE vec_id % 10 = 0),
 found AS (SELECT nprobe, c.query_id, c.vec_id, row_number() OVER (PARTITION BY nprobe, c.query_id ORDER BY dist, c.vec_id) AS n
   FROM c JOIN probed ON c.query_id = probed.query_id AND c.cid = probed.cid JOIN (VALUES (1), (2), (4), (8), (10)) t(nprobe) ON place <= nprobe)
SELECT nprobe, CAST(count(hit) AS DOUBLE) / (SELECT count(*) FROM exact) AS recall
FROM found LEFT JOIN exact USING (query_id, vec_id) WHERE n <= 10 GROUP BY nprobe""")


# Plans and replies

def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _indexed(spark, sf_dir)
    texts = [db.explain(f"SELECT {x}") for x in ("k FROM l", "k FROM l WHERE k = 25", "* FROM l WHERE n >= 2 AND k = 25", "SUM(p) FROM l WHERE n > 2")]
    db.sql("REFRESH COLUMNAR l")
    texts.append(db.explain("SELECT SUM(p) FROM l"))
    return spark.createDataFrame(list(enumerate(texts)), "n int, text string")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _orders(spark, sf_dir)
    lines = ("INSERT INTO o VALUES (-7, 1, 'x')", "DELETE FROM o WHERE k < 0", "SELECT k FROM nope", "SELECT AVG(c) FROM o WHERE k = -7", "SELECT COUNT(*) FROM o WHERE k > 0 AND k <= 9")
    return spark.createDataFrame([(i, answer(db, line)) for i, line in enumerate(lines)], "n int, text string")


_register("q_explain", _explained, """
SELECT CAST(n AS INT) AS n, replace(text, '~', chr(10) || ' ') AS text FROM (VALUES
 (0, 'Project(1 columns)~SeqScan(l) [no matching index -> full scan]'), (1, 'Project(1 columns)~IndexScan(l.k = 25)'),
 (2, 'Project(3 columns)~Filter(2 predicates)~IndexScan(l.k = 25)'),
 (3, 'RowAggregate(SUM(p))~Filter(1 predicates)~SeqScan(l) [no matching index -> full scan]'),
 (4, 'ColumnarAggregate(SUM(p)) [from REFRESH COLUMNAR cache]')) t(n, text)""")
_register("q_replies", _replies, """
SELECT CAST(n AS INT) AS n, replace(text, '~', chr(9)) AS text FROM (VALUES (0, 'OK~1~~'), (1, 'OK~1~~'), (2, 'ERR Unknown table nope'),
 (3, 'ERR AVG(c) over zero matching rows is undefined'),
 (4, 'OK~0~COUNT(*)~' || (SELECT count(*) FROM orders WHERE o_orderkey > 0 AND o_orderkey <= 9))) t(n, text)""")


# Text forms

def _vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_vector_text(_engine(spark, sf_dir, "embeddings").dataframe("embeddings"), "embedding", "text").select("vec_id", "text")


_register("q_vec_to_string", _vector_text, """
SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:4], lambda x: printf('%.6f', x::DOUBLE)), ',') || CASE WHEN len(embedding) > 4 THEN ',...' ELSE '' END
  || '] (' || len(embedding) || 'd)' AS text FROM embeddings""")


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = encode(_engine(spark, sf_dir, "region").sql("SELECT * FROM region"))
    head, rows = line.rsplit("\t", 1)
    # Rows come in no set order.
    return spark.createDataFrame([(head + "\t" + "|".join(sorted(rows.split("|"))),)], "line string")


_register("q_wire", _wire, """
SELECT 'OK' || chr(9) || '0' || chr(9) || 'r_regionkey,r_name' || chr(9) || string_agg(r_regionkey || ';' || r_name, '|' ORDER BY r_regionkey || ';' || r_name) AS line FROM region""")

