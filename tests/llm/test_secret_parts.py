"""Random keys inside longer runs and beside fixed spans."""

import random

from weftgraph.llm import secrets

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
WORDS = ["source", "main", "resources", "static", "internal", "modules", "service", "handler", "config", "template", "release", "customer", "station"]


def _docs():
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    path = lambda n: "/".join(rng.choice(WORDS) for _ in range(n))
    train = [(i, f"{path(9)} password={key(40)} {'-'.join(rng.choice(WORDS) for _ in range(5))}") for i in range(400)]
    hidden = [key(40) for _ in range(6)]
    hex_ = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    access = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP") for _ in range(16))
    texts = [
        f"see {path(9)}/{hidden[0]} here", f"{path(4)}/{hidden[1]}/{path(9)}", f"{'_'.join(WORDS)}={hidden[2]}", f"{path(9)}/{hidden[3]}/{path(9)}/{hidden[4]}",
        f"dir/{hex_}/{hidden[5]}", f"{path(9)}/{access}/{path(9)}", f"plain {path(12)}",
    ]
    return train + [(1000 + i, t) for i, t in enumerate(texts)], hidden


def test_keys_inside_runs(spark):
    docs, hidden = _docs()
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    cut = {r["doc_id"]: r["text"] for r in secrets.redacted(table).collect()}
    left = " ".join(t for i, t in cut.items() if i >= 1000)
    assert not any(k[i:i + 6] in left for k in hidden for i in range(35))
    assert cut[1006] == dict(docs)[1006] and cut[1005].count("[secret]") == 1
    assert cut[1000].startswith("see " + dict(docs)[1000][4:40])
    found = {r["doc_id"]: r["_spans"] for r in secrets.scan_secrets(table).collect()}
    assert [s["kind"] for s in found[1003]] == ["random", "random"] and [s["kind"] for s in found[1004]] == ["hex", "random"]
