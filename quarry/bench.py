"""A load generator for the line protocol.

``python -m quarry.bench --port N --clients 4 --queries-per-client 50 --seed-rows 150 [--read-only]``
seeds three tables and has each client send a mix of statements: 40 % inserts,
30 % indexed point reads, 15 % aggregates and 15 % nearest-neighbour searches,
or without inserts 50, 25 and 25 %. Prints one line of JSON.
"""

from __future__ import annotations

import argparse
import json
import random
import socket
import threading
import time
from collections import Counter

DIM = 8
#: Shares of the kinds of statements: fixed values of the workload.
MIXED = {"insert": 40, "point": 30, "aggregate": 15, "nearest": 15}
READ_ONLY = {"point": 50, "aggregate": 25, "nearest": 25}


class Client:
    def __init__(self, port: int, host: str = "127.0.0.1") -> None:
        self.socket = socket.create_connection((host, port))
        self.file = self.socket.makefile("rw")

    def ask(self, line: str) -> str:
        self.file.write(line + "\n")
        self.file.flush()
        return self.file.readline().rstrip("\n")

    def close(self) -> None:
        self.file.close()
        self.socket.close()


def vector(rng: random.Random) -> str:
    return "[" + ",".join(f"{rng.uniform(0, 100):.4f}" for _ in range(DIM)) + "]"


def seed(client: Client, rows: int) -> None:
    rng = random.Random(42)
    lines = ["CREATE TABLE bench_rel (id INT, val INT)", "CREATE TABLE bench_analytics (id INT, amount INT)", f"CREATE TABLE bench_vectors (id INT, embedding VECTOR({DIM}))"]
    for i in range(rows):
        lines += [f"INSERT INTO bench_rel VALUES ({i}, {i % 1000})", f"INSERT INTO bench_analytics VALUES ({i}, {37 * i % 5000})", f"INSERT INTO bench_vectors VALUES ({i}, {vector(rng)})"]
    lines += ["CREATE INDEX bench_by_id ON bench_rel (id)", "REFRESH COLUMNAR bench_analytics", f"CREATE VECTOR INDEX bench_near ON bench_vectors (embedding) LISTS {max(2, rows // 20)}"]
    for line in lines:
        if not (reply := client.ask(line)).startswith("OK"):
            raise RuntimeError(f"{line}: {reply}")


def statement(kind: str, rng: random.Random, rows: int, fresh) -> str:
    if kind == "insert":
        return f"INSERT INTO bench_rel VALUES ({next(fresh)}, {rng.randrange(1000)})"
    if kind == "point":
        return f"SELECT * FROM bench_rel WHERE id = {rng.randrange(rows)}"
    if kind == "aggregate":
        return f"SELECT {rng.choice(['SUM(amount)', 'AVG(amount)', 'COUNT(*)', 'MIN(amount)', 'MAX(amount)'])} FROM bench_analytics"
    return f"SELECT id FROM bench_vectors ORDER BY embedding <-> {vector(rng)} LIMIT 5"


def run(port: int, clients: int, per_client: int, rows: int, read_only: bool) -> dict:
    mix, done, errors = READ_ONLY if read_only else MIXED, Counter(), Counter()

    def work(number: int) -> None:
        rng, client = random.Random(number), Client(port)
        fresh = iter(range(10**6 * (number + 1), 10**6 * (number + 2)))
        for kind in rng.choices(list(mix), list(mix.values()), k=per_client):
            ok = client.ask(statement(kind, rng, rows, fresh)).startswith("OK")
            (done if ok else errors)[kind] += 1
        client.close()

    threads = [threading.Thread(target=work, args=(i,)) for i in range(clients)]
    start = time.perf_counter()
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    seconds = time.perf_counter() - start
    return {"queries_per_sec": round(sum(done.values()) / seconds, 2), "done": dict(done), "errors": dict(errors), "clients": clients, "read_only": read_only}


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--port", type=int, required=True)
    p.add_argument("--clients", type=int, default=4)
    p.add_argument("--queries-per-client", type=int, default=50)
    p.add_argument("--seed-rows", type=int, default=150)
    p.add_argument("--read-only", action="store_true")
    args = p.parse_args()
    client = Client(args.port)
    seed(client, args.seed_rows)
    client.close()
    print(json.dumps(run(args.port, args.clients, args.queries_per_client, args.seed_rows, args.read_only)))


if __name__ == "__main__":
    main()
