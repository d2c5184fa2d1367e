"""Statements, transactions, indexes, vectors and restarts through the engine."""

import numpy as np
import pytest

from quarry.engine import Engine, answer
from quarry.errors import EngineError, FencedError, SqlSyntaxError


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "db")


@pytest.fixture()
def db(spark, root):
    return Engine(spark, root)


def rows(result):
    return sorted(map(tuple, result.rows))


def fill(db, sql, *values):
    db.executemany([sql.format(*v) if isinstance(v, tuple) else sql.format(v) for v in values])


def test_create_insert_select(db):
    db.sql("CREATE TABLE users (id INT, name TEXT)")
    fill(db, "INSERT INTO users VALUES ({}, '{}')", (1, "alice"), (2, "bob"), (3, "charlie"))
    assert rows(db.sql("SELECT * FROM users")) == [(1, "alice"), (2, "bob"), (3, "charlie")]
    assert rows(db.sql("SELECT name FROM users WHERE id = 2")) == [("bob",)]
    assert rows(db.sql("select name, id from users where id >= 2 and name != 'bob';")) == [("charlie", 3)]
    found = db.sql("SELECT id FROM users WHERE name != 'alice' AND id < 3")
    assert found.explain == "Project(1 columns)\n Filter(2 predicates)\n SeqScan(users) [no matching index -> full scan]"
    with pytest.raises(EngineError, match="already exists"):
        db.sql("CREATE TABLE users (id INT)")
    for bad in ("SELECT nope FROM users", "SELECT * FROM users WHERE nope = 1", "SELECT * FROM users WHERE id = 'x'", "SELECT * FROM nope"):
        with pytest.raises(EngineError):
            db.sql(bad)
    for bad in ("INSERT INTO users VALUES (1)", "INSERT INTO users VALUES ('x', 'y')"):
        with pytest.raises(EngineError):
            db.sql(bad)


@pytest.mark.parametrize("bad", [
    "", "UPDATE t SET a = 1", "SELECT * FROM t LIMIT 5", "SELECT * FROM t WHERE a = 1 OR b = 2", "SELECT SUM(a), SUM(b) FROM t",
    "CREATE TABLE t (a VARCHAR(20))", "CREATE VECTOR INDEX i ON t (v) LISTS 0", "SELECT a FROM t ORDER BY v <-> [1] LIMIT -1",
    "SELECT COUNT(*) FROM t ORDER BY v <-> [1] LIMIT 1", "SELECT * FROM t WHERE a <> 1", "SELECT # FROM t", "CREATE TABLE t (a INT, a INT)",
])
def test_syntax_errors(db, bad):
    with pytest.raises(SqlSyntaxError):
        db.sql(bad)


def test_decimals_are_cut_in_integer_places(db):
    db.sql("CREATE TABLE t (a INT)")
    fill(db, "INSERT INTO t VALUES ({})", "2.9", "-2.9")
    assert rows(db.sql("SELECT a FROM t")) == [(-2,), (2,)]


def test_versions(db):
    db.sql("CREATE TABLE t (id INT, name TEXT)")
    with pytest.raises(EngineError, match="requires an active transaction"):
        db.execute("INSERT INTO t VALUES (1, 'a')")
    fill(db, "INSERT INTO t VALUES ({}, 'x')", 1, 2, 3)
    txn = db.begin()
    assert db.execute("DELETE FROM t WHERE id = 2", txn).rows_affected == 1
    db.execute("INSERT INTO t VALUES (4, 'mine')", txn)
    assert rows(db.execute("SELECT id FROM t", txn)) == [(1,), (3,), (4,)]
    assert rows(db.execute("SELECT id FROM t")) == [(1,), (2,), (3,)]
    assert db.execute("DELETE FROM t WHERE name = 'mine'", txn).rows_affected == 1
    assert rows(db.execute("SELECT id FROM t", txn)) == [(1,), (3,)]
    db.commit(txn)
    assert rows(db.execute("SELECT id FROM t")) == [(1,), (3,)]
    txn = db.begin()
    db.execute("DELETE FROM t", txn)
    db.execute("INSERT INTO t VALUES (9, 'x')", txn)
    db.abort(txn)
    assert rows(db.execute("SELECT id FROM t")) == [(1,), (3,)]
    with pytest.raises(EngineError):
        db.commit(txn)
    # A later delete that is aborted doesn't undo an earlier one that is committed.
    first, second = db.begin(), db.begin()
    db.execute("DELETE FROM t WHERE id = 1", first)
    db.execute("DELETE FROM t WHERE id = 1", second)
    db.commit(first)
    db.abort(second)
    assert rows(db.execute("SELECT id FROM t")) == [(3,)]


def test_restart_drops_what_was_not_published(spark, root):
    db = Engine(spark, root)
    db.sql("CREATE TABLE t (id INT)")
    fill(db, "INSERT INTO t VALUES ({})", 1, 2)
    open_txn = db.begin()
    db.load("t", spark.range(100).select("id"), open_txn)
    db.execute("DELETE FROM t WHERE id = 1", open_txn)
    again = Engine(spark, root)
    assert again.recovered == 2
    assert rows(again.sql("SELECT id FROM t")) == [(1,), (2,)]
    fill(again, "INSERT INTO t VALUES ({})", 3)
    assert rows(Engine(spark, root, write=False).sql("SELECT id FROM t")) == [(1,), (2,), (3,)]
    with pytest.raises(FencedError):
        db.sql("INSERT INTO t VALUES (7)")
    with pytest.raises(EngineError, match="not the primary"):
        Engine(spark, root, write=False).sql("INSERT INTO t VALUES (7)")


def test_secondary_index(spark, root):
    db = Engine(spark, root)
    db.sql("CREATE TABLE accounts (id INT, balance INT)")
    fill(db, "INSERT INTO accounts VALUES ({}, {})", *[(i, 100 * i) for i in range(50)])
    assert "SeqScan" in db.sql("SELECT * FROM accounts WHERE id = 25").explain
    db.sql("CREATE INDEX idx ON accounts (id)")
    for bad in ("CREATE INDEX idx ON accounts (balance)", "CREATE INDEX j ON accounts (nope)", "CREATE INDEX j ON nope (id)"):
        with pytest.raises(EngineError):
            db.sql(bad)
    found = db.sql("SELECT * FROM accounts WHERE id = 25")
    assert found.explain == "Project(2 columns)\n IndexScan(accounts.id = 25)" and rows(found) == [(25, 2500)]
    scanned = found.dataframe.inputFiles()
    assert scanned and all("/_b=9/" in f for f in scanned)
    found = db.sql("SELECT balance FROM accounts WHERE balance > 10 AND id = 25")
    assert "Filter(2 predicates)\n IndexScan" in found.explain and rows(found) == [(2500,)]
    db.sql("INSERT INTO accounts VALUES (999, 5000)")
    assert rows(db.sql("SELECT balance FROM accounts WHERE id = 999")) == [(5000,)]
    db.sql("DELETE FROM accounts WHERE id = 999")
    db.sql("INSERT INTO accounts VALUES (999, 1)")
    assert rows(db.sql("SELECT balance FROM accounts WHERE id = 999")) == [(1,)]
    txn = db.begin()
    db.execute("INSERT INTO accounts VALUES (999, 2)", txn)
    assert rows(db.execute("SELECT balance FROM accounts WHERE id = 999", txn)) == [(1,), (2,)]
    assert rows(db.execute("SELECT balance FROM accounts WHERE id = 999")) == [(1,)]
    db.abort(txn)
    again = Engine(spark, root)
    assert rows(again.sql("SELECT balance FROM accounts WHERE id = 999")) == [(1,)]
    assert sorted(r[0] for r in again.between("idx", 10, 12).collect()) == [10, 11, 12]
    keys = spark.createDataFrame([(3,), (4,), (4,), (77,)], "k long")
    assert sorted(r[0] for r in again.lookup_many("idx", keys).collect()) == [3, 4]
    again.compact("accounts")
    assert rows(again.sql("SELECT balance FROM accounts WHERE id = 999")) == [(1,)]
    assert again.sql("SELECT COUNT(*) FROM accounts").rows == [[51]]


def test_aggregates_and_stale_snapshots(spark, root):
    db = Engine(spark, root)
    db.sql("CREATE TABLE sales (id INT, amount INT)")
    fill(db, "INSERT INTO sales VALUES ({}, {})", *[(i, 10 * i) for i in range(1, 21)])
    expected = {"SUM(amount)": 2100, "AVG(amount)": "105.0000", "COUNT(*)": 20, "COUNT(id)": 20, "MIN(amount)": 10, "MAX(amount)": 200}
    for refreshed in (False, True):
        if refreshed:
            db.sql("REFRESH COLUMNAR sales")
        for what, value in expected.items():
            found = db.sql(f"SELECT {what} FROM sales")
            assert found.column_names == [what] and found.rows == [[value]]
            assert found.explain.startswith("ColumnarAggregate" if refreshed else "RowAggregate")
    found = db.sql("SELECT SUM(amount) FROM sales WHERE id > 15")
    assert found.rows == [[900]] and found.explain.startswith("RowAggregate(SUM(amount))\n Filter(1 predicates)")
    db.sql("INSERT INTO sales VALUES (999, 100000)")
    assert db.sql("SELECT SUM(amount) FROM sales").rows == [[2100]]
    assert db.sql("SELECT COUNT(*) FROM sales WHERE id > 0").rows == [[21]]
    plan = db.cache.get("sales").rows._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    db.sql("REFRESH COLUMNAR sales")
    assert db.sql("SELECT SUM(amount) FROM sales").rows == [[102100]]
    assert Engine(spark, root, write=False).sql("SELECT SUM(amount) FROM sales").explain.startswith("RowAggregate")
    for bad in ("SELECT SUM(nope) FROM sales", "SELECT COUNT(nope) FROM sales", "REFRESH COLUMNAR nope"):
        with pytest.raises(EngineError):
            db.sql(bad)


def test_aggregates_over_nothing(db):
    db.sql("CREATE TABLE empty_t (id INT, v INT, name TEXT)")
    for refreshed in (False, True):
        if refreshed:
            db.sql("REFRESH COLUMNAR empty_t")
        assert db.sql("SELECT COUNT(*) FROM empty_t").rows == [[0]]
        for f in ("SUM", "AVG", "MIN", "MAX"):
            with pytest.raises(EngineError, match="zero matching rows"):
                db.sql(f"SELECT {f}(v) FROM empty_t")
    with pytest.raises(EngineError, match="requires an INT column"):
        db.sql("SELECT SUM(name) FROM empty_t")


def vector(v):
    return "[" + ",".join(f"{x:.6f}" for x in v) + "]"


def test_vectors(spark, root):
    db = Engine(spark, root)
    rng = np.random.default_rng(42)
    data = [np.arange(1.0, 9.0), *rng.uniform(0, 100, (39, 8))]
    db.sql("CREATE TABLE docs (id INT, embedding VECTOR(8))")
    fill(db, "INSERT INTO docs VALUES ({}, {})", *[(i, vector(v)) for i, v in enumerate(data)])
    first = f"SELECT id FROM docs ORDER BY embedding <-> {vector(data[0])} LIMIT 3"
    with pytest.raises(EngineError, match="No vector index"):
        db.sql(first)
    with pytest.raises(EngineError):
        db.sql("CREATE VECTOR INDEX big ON docs (embedding) LISTS 41")
    db.sql("CREATE VECTOR INDEX v ON docs (embedding) LISTS 4")
    found = db.sql(first)
    assert found.explain == "VectorIndexScan(docs.embedding <-> query, k=3, nprobe=4)"
    exact = np.argsort([((v - data[0]) ** 2).sum() for v in data])[:3].tolist()
    assert [r[0] for r in found.rows] == exact
    hybrid = db.sql(f"SELECT id FROM docs WHERE id > 20 ORDER BY embedding <-> {vector(data[0])} LIMIT 5")
    assert hybrid.explain.endswith("\n PostFilter(1 predicates)")
    near = np.argsort([((v - data[0]) ** 2).sum() for v in data])[:20].tolist()
    assert [r[0] for r in hybrid.rows] == [i for i in near if i > 20][:5]
    with pytest.raises(EngineError):
        db.sql("SELECT id FROM docs ORDER BY embedding <-> [1,2] LIMIT 3")
    with pytest.raises(EngineError):
        db.sql("INSERT INTO docs VALUES (1, [1,2])")
    txn = db.begin()
    db.execute(f"INSERT INTO docs VALUES (999, {vector([100] * 8)})", txn)
    top = f"SELECT id FROM docs ORDER BY embedding <-> {vector([100] * 8)} LIMIT 1"
    assert db.execute(top, txn).rows == [[999]] and db.execute(top).rows != [[999]]
    db.commit(txn)
    again = Engine(spark, root)
    assert again.sql(top).rows == [[999]]
    assert again.store.state.vector_indexes["v"].centroids == db.store.state.vector_indexes["v"].centroids
    again.sql("DELETE FROM docs WHERE id = 999")
    assert again.sql(top).rows != [[999]]
    assert again.sql(f"SELECT id FROM docs ORDER BY embedding <-> {vector(data[0])} LIMIT 0").rows == []


def test_recall_by_probes(spark, root):
    db = Engine(spark, root)
    rng = np.random.default_rng(7)
    data = rng.uniform(0, 100, (800, 8)).astype(np.float32)
    db.sql("CREATE TABLE e (id INT, v VECTOR(8))")
    txn = db.begin()
    db.load("e", spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<float>"), txn)
    db.commit(txn)
    db.sql("CREATE VECTOR INDEX i ON e (v) LISTS 20")
    queries = rng.uniform(0, 100, (50, 8))
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id long, vector array<double>")
    exact = [set(np.argsort(((data.astype(float) - q) ** 2).sum(axis=1), kind="stable")[:10].tolist()) for q in queries]
    recall = {}
    for nprobe in (1, 2, 4, 8, 20):
        hits = sum(r["id"] in exact[r["query_id"]] for r in db.search_many("i", asked, 10, nprobe).collect())
        recall[nprobe] = hits / 500
    assert recall[1] <= recall[2] <= recall[4] <= recall[8] <= recall[20] == 1.0
    assert recall[4] >= 0.8 and recall[8] >= 0.95
    one = [r["id"] for r in db.search("i", queries[0].tolist(), 10, 20).collect()]
    assert set(one) == exact[0]


def test_load_refuses_what_the_table_cannot_hold(spark, db):
    db.sql("CREATE TABLE e (id INT, v VECTOR(2))")
    for bad in ((None, [1.0, 2.0]), (1, [1.0]), (1, [1.0, None]), (1, None)):
        txn = db.begin()
        with pytest.raises(Exception, match="cannot hold"):
            db.load("e", spark.createDataFrame([bad], "id long, v array<float>"), txn)
        db.abort(txn)
    assert db.sql("SELECT COUNT(*) FROM e").rows == [[0]]


def test_line_protocol(db):
    talk = [
        ("CREATE TABLE users (id INT, name TEXT, age INT)", "OK\t0\t\t"), ("CREATE INDEX idx_users_id ON users (id)", "OK\t0\t\t"),
        ("INSERT INTO users VALUES (1, 'alice', 31)", "OK\t1\t\t"), ("INSERT INTO users VALUES (2, 'bob', 27)", "OK\t1\t\t"),
        ("INSERT INTO users VALUES (3, 'carol', 45)", "OK\t1\t\t"), ("SELECT * FROM users WHERE id = 2", "OK\t0\tid,name,age\t2;bob;27"),
        ("SELECT AVG(age) FROM users", "OK\t0\tAVG(age)\t34.3333"), (" DELETE FROM users WHERE id = 1", "OK\t1\t\t"),
        ("SELECT * FROM nope", "ERR Unknown table nope"), ("CREATE TABLE docs (id INT, emb VECTOR(5))", "OK\t0\t\t"),
        ("INSERT INTO docs VALUES (1, [0.1,0.2,0.3,0.4,0.5])", "OK\t1\t\t"),
        ("SELECT emb FROM docs", "OK\t0\temb\t[0.100000,0.200000,0.300000,0.400000,...] (5d)"),
    ]
    for line, reply in talk:
        assert answer(db, line) == reply
    assert sorted(answer(db, "SELECT name FROM users WHERE age > 20").split("\t")[3].split("|")) == ["bob", "carol"]


def test_server(db):
    import socket
    import threading

    from quarry.server import LineServer

    with LineServer(db) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with socket.create_connection(server.server_address) as s, s.makefile("rw") as f:
            for line, reply in (("PING", "PONG"), ("CREATE TABLE t (a INT)", "OK\t0\t\t"), ("INSERT INTO t VALUES (5)", "OK\t1\t\t"), ("SELECT SUM(a) FROM t", "OK\t0\tSUM(a)\t5")):
                f.write(line + "\n")
                f.flush()
                assert f.readline().rstrip("\n") == reply
            for line, reply in (("STATUS", "STATUS PRIMARY 1"), ("QUERY SELECT a FROM t", "OK\t0\ta\t5"), ("query INSERT INTO t VALUES (6)", "OK\t1\t\t"),
                                ("PROMOTE 5", "ACK"), ("STATUS", "STATUS PRIMARY 5"), ("PROMOTE 3", "REJECT stale epoch 3 < 5"), ("NOTIFY 5", "ACK"), ("PROMOTE x", "ERR x is no epoch"),
                                ("INSERT INTO t VALUES (7)", "OK\t1\t\t")):
                f.write(line + "\n")
                f.flush()
                assert f.readline().rstrip("\n") == reply
            f.write("STATS\n")
            f.flush()
            assert "OK role=primary" in f.readline()
        server.shutdown()


def test_router(spark, root, monkeypatch):
    """Writes go to the writer, reads in turn to all; when the writer is gone, another is elected and takes writes."""
    import threading
    import time

    from quarry import router as routing
    from quarry.server import LineServer

    monkeypatch.setattr(routing, "HEARTBEAT", 0.1)
    engines = [Engine(spark, root), Engine(spark, root, write=False), Engine(spark, root, write=False)]
    servers = [LineServer(e) for e in engines]
    for s in servers:
        threading.Thread(target=s.serve_forever, daemon=True).start()
    router = routing.Router([s.server_address for s in servers])
    with routing.RouterServer(router) as front:
        threading.Thread(target=front.serve_forever, daemon=True).start()
        client = routing.Server(*front.server_address)
        assert client.ask("CREATE TABLE t (a INT)") == "OK\t0\t\t" and client.ask("query INSERT INTO t VALUES (1)") == "OK\t1\t\t"

        def settled(what):
            for _ in range(200):
                if what():
                    return True
                time.sleep(0.1)
            return False

        assert settled(lambda: all(e.store.log.lsn == 2 for e in engines))  # told, not asked
        assert {client.ask("SELECT a FROM t") for _ in range(3)} == {"OK\t0\ta\t1"} and all(s.served >= 2 for s in servers)
        assert sorted(router.ask_all("STATUS")) == ["STATUS PRIMARY 1", "STATUS REPLICA 1", "STATUS REPLICA 1"]
        servers[0].shutdown()
        servers[0].server_close()
        assert settled(lambda: router.writer is router.servers[1])
        assert settled(lambda: client.ask("INSERT INTO t VALUES (2)") == "OK\t1\t\t") and router.epoch == 2
        with pytest.raises(FencedError):
            engines[0].sql("INSERT INTO t VALUES (3)")
        assert settled(lambda: engines[2].store.log.lsn >= 3)
        assert sorted(client.ask("SELECT a FROM t").split("\t")[3].split("|")) == ["1", "2"]
        front.shutdown()
    router.close()
    for s in servers[1:]:
        s.shutdown()
        s.server_close()


def test_load_generator(db):
    import threading

    from quarry import bench
    from quarry.server import LineServer

    with LineServer(db) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        port = server.server_address[1]
        client = bench.Client(port)
        for line in ("CREATE TABLE bench_rel (id INT, val INT)", "CREATE TABLE bench_analytics (id INT, amount INT)", "CREATE TABLE bench_vectors (id INT, embedding VECTOR(8))"):
            assert client.ask(line).startswith("OK")
        rng = bench.random.Random(1)
        db.executemany([s for i in range(40) for s in (f"INSERT INTO bench_rel VALUES ({i}, {i})", f"INSERT INTO bench_analytics VALUES ({i}, {i})", f"INSERT INTO bench_vectors VALUES ({i}, {bench.vector(rng)})")])
        assert client.ask("CREATE VECTOR INDEX n ON bench_vectors (embedding) LISTS 2").startswith("OK")
        client.close()
        found = bench.run(port, 2, 6, 40, read_only=False)
        assert found["errors"] == {} and sum(found["done"].values()) == 12
        server.shutdown()


def test_follower(spark, root, tmp_path):
    from quarry.streaming.follower import Follower

    db = Engine(spark, root)
    db.sql("CREATE TABLE t (id INT)")
    db.sql("INSERT INTO t VALUES (1)")
    follower = Follower(spark, root, str(tmp_path / "offsets"))
    assert rows(follower.engine.sql("SELECT id FROM t")) == [(1,)] and follower.catch_up() == 0
    db.sql("INSERT INTO t VALUES (2)")
    assert rows(follower.engine.sql("SELECT id FROM t")) == [(1,)]
    assert follower.catch_up() == 1 and follower.catch_up() == 0
    assert rows(follower.engine.sql("SELECT id FROM t")) == [(1,), (2,)]
    # A follower that is started again on its checkpoint knows all and goes on.
    db.sql("INSERT INTO t VALUES (3)")
    again = Follower(spark, root, str(tmp_path / "offsets"))
    assert rows(again.engine.sql("SELECT id FROM t")) == [(1,), (2,), (3,)]
    db.sql("INSERT INTO t VALUES (4)")
    assert again.catch_up() == 1 and again.waiting == {}
    promoted = again.promote()
    promoted.sql("INSERT INTO t VALUES (5)")
    assert rows(promoted.sql("SELECT id FROM t")) == [(i,) for i in range(1, 6)]
    with pytest.raises(FencedError):
        db.sql("INSERT INTO t VALUES (6)")


def test_follower_of_torn_records(spark, root, tmp_path):
    """A record that the stream met empty or half written is read from its file later on."""
    from quarry.streaming.follower import Follower

    db = Engine(spark, root)
    db.sql("CREATE TABLE t (id INT)")
    follower = Follower(spark, root, str(tmp_path / "offsets"))
    name = tmp_path / "db" / "_log" / f"{2:020d}.json"
    for torn in ("", '{"lsn": 2, "ty'):
        name.write_text(torn)
        assert follower.catch_up() == 0
    name.unlink()
    db = Engine(spark, root)
    db.sql("INSERT INTO t VALUES (1)")
    assert follower.catch_up() == 1
    db.sql("INSERT INTO t VALUES (2)")
    assert follower.catch_up() == 1 and rows(follower.engine.sql("SELECT id FROM t")) == [(1,), (2,)]


def test_follower_that_keeps_up(spark, root, tmp_path):
    import time

    from quarry.streaming.follower import Follower

    db = Engine(spark, root)
    db.sql("CREATE TABLE t (id INT)")
    follower = Follower(spark, root, str(tmp_path / "offsets"))
    query = follower.follow("200 milliseconds")
    try:
        db.sql("INSERT INTO t VALUES (1)")
        for _ in range(150):
            if follower.engine.store.log.lsn == 2:
                break
            time.sleep(0.2)
        assert rows(follower.engine.sql("SELECT id FROM t")) == [(1,)]
    finally:
        query.stop()


def test_torn_log(spark, root, tmp_path):
    """Half a last record is as if it had not been written; a damaged one before the end is an error."""
    db = Engine(spark, root)
    db.sql("CREATE TABLE t (id INT)")
    db.sql("INSERT INTO t VALUES (1)")
    log = tmp_path / "db" / "_log"
    whole = (log / f"{2:020d}.json").read_text()
    (log / f"{3:020d}.json").write_text(whole[: len(whole) // 2])
    assert rows(Engine(spark, root, write=False).sql("SELECT id FROM t")) == [(1,)]
    again = Engine(spark, root)
    again.sql("INSERT INTO t VALUES (2)")
    assert rows(Engine(spark, root, write=False).sql("SELECT id FROM t")) == [(1,), (2,)]
    (log / f"{2:020d}.json").write_text(whole[:20])
    with pytest.raises(EngineError, match="damaged"):
        Engine(spark, root)


def test_log_checkpoint_and_past_states(spark, root, tmp_path, monkeypatch):
    from quarry.sources import store

    monkeypatch.setattr(store, "CHECKPOINT_EVERY", 4)
    db = Engine(spark, root)
    db.sql("CREATE TABLE t (id INT)")
    db.sql("CREATE INDEX i ON t (id)")
    for i in range(5):
        db.sql(f"INSERT INTO t VALUES ({i})")
    db.sql("DELETE FROM t WHERE id = 1")
    again = Engine(spark, root)
    assert again.store.log.base == 8 and again.store.log.records == []
    assert rows(again.sql("SELECT id FROM t")) == [(0,), (2,), (3,), (4,)] and rows(again.sql("SELECT id FROM t WHERE id = 3")) == [(3,)]
    again.sql("INSERT INTO t VALUES (9)")
    assert again.begin().id > max(again.store.state.committed)
    for at, n in ((4, 2), (5, 3), (7, 5), (8, 4), (9, 5)):
        past = Engine(spark, root, at=at)
        assert past.sql("SELECT COUNT(*) FROM t").rows == [[n]]
        with pytest.raises(EngineError):
            past.sql("INSERT INTO t VALUES (1)")


def test_publishing_never_replaces(spark, tmp_path):
    from quarry.sources.files import Files

    files = Files(spark, str(tmp_path))
    for n, way in enumerate((files._link, files._rename)):
        files._link = way
        assert files.publish(f"a{n}", "one") and not files.publish(f"a{n}", "two") and files.read(f"a{n}") == "one"
    assert files.names("_tmp") == []


def test_replace(spark, db):
    db.sql("CREATE TABLE t (id INT, v INT)")
    fill(db, "INSERT INTO t VALUES ({}, {})", (1, 10), (2, 20), (2, 21))
    txn = db.begin()
    assert db.replace("t", spark.createDataFrame([(2, 5), (3, 6)], "id long, v long"), "id", txn) == 2
    assert rows(db.sql("SELECT id, v FROM t")) == [(1, 10), (2, 20), (2, 21)]
    db.commit(txn)
    assert rows(db.sql("SELECT id, v FROM t")) == [(1, 10), (2, 5), (3, 6)]


def test_index_grows_and_splits_hot_keys(spark, db, monkeypatch):
    from quarry.operators import secondary

    db.sql("CREATE TABLE t (id INT, v INT)")
    db.sql("CREATE INDEX i ON t (id)")
    assert db.store.state.indexes["i"].buckets == 16
    monkeypatch.setattr(secondary, "ROWS_PER_BUCKET", 100)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        txn = db.begin()
        db.load("t", spark.range(20_000).selectExpr("IF(id % 3 = 0, 7, id) AS id", "id AS v"), txn)
        db.commit(txn)
        hot = [p for p in db.store.state.indexes["i"].files if "/_b=7/" in p]
        assert len(hot) > 1
        db.compact("t")
        assert db.store.state.indexes["i"].buckets == 200
        assert db.sql("SELECT COUNT(*) FROM t WHERE id = 7").rows == [[6668]] and rows(db.sql("SELECT v FROM t WHERE id = 100")) == [(100,)]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_batch_search_in_small_cells(spark, db, monkeypatch):
    from quarry.operators import ivf

    monkeypatch.setattr(ivf, "CELL_ROWS", 7)
    monkeypatch.setattr(ivf, "CELL_QUERIES", 5)
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.normal(0, 1, (60, 4)), rng.normal(9, 1, (20, 4))]).astype(np.float32)
    db.sql("CREATE TABLE e (id INT, v VECTOR(4), name TEXT)")
    txn = db.begin()
    db.load("e", spark.createDataFrame([(i, v.tolist(), f"n{i}") for i, v in enumerate(data)], "id long, v array<float>, name string"), txn)
    db.commit(txn)
    db.sql("CREATE VECTOR INDEX i ON e (v) LISTS 2")
    asked = spark.createDataFrame([(i, data[i].tolist()) for i in range(0, 80, 4)], "query_id long, vector array<float>")
    found = {(r["query_id"], r["rank"]): (r["id"], r["name"]) for r in db.search_many("i", asked, 3, 2).collect()}
    for i in range(0, 80, 4):
        near = np.argsort(((data.astype(float) - data[i]) ** 2).sum(axis=1), kind="stable")[:3]
        assert [found[i, k] for k in (1, 2, 3)] == [(n, f"n{n}") for n in near]


def test_registered_tables(spark, db, sf_dir):
    db.register_parquet("lineitem", f"{sf_dir}/lineitem.parquet")
    found = db.sql("SELECT SUM(l_linenumber) FROM lineitem WHERE l_orderkey > 15")
    plain = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey > 15").selectExpr("sum(l_linenumber)").first()[0]
    assert found.rows == [[plain]]
    plan = db.sql("SELECT l_orderkey FROM lineitem WHERE l_orderkey = 25").dataframe._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,25)]" in plan and "ReadSchema: struct<l_orderkey:bigint>" in plan
    with pytest.raises(EngineError, match="read-only"):
        db.sql("DELETE FROM lineitem")
    with pytest.raises(EngineError):
        db.sql("SELECT * FROM lineitem WHERE l_tax = 1")
