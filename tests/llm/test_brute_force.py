"""Operators against slow, plain versions, exact round trips and held-out accuracy."""

import base64
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import components, decontamination, exact_dedup, language_id, licenses, mixing, near_dedup, quality, secrets, sharding, tokens, toxicity
from millrace.llm.common import Stage, maybe_in

DATA = "/root/testdata/sf0.01"


def plain_components(texts, percent, width=5):
    """Sets, all pairs, union-find."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def mutants(seed=3):
    """Distant and close copies of a few texts, chains among them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for size in (14, 40, 120, 150):
        base = [rng.choice(vocabulary) for _ in range(size)]
        chain = list(base)
        for k in range(35):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(size)] = rng.choice(vocabulary[:30])
            texts[n] = " ".join(words).title() if k % 3 else "\t".join(words)
            chain[rng.randrange(size)] = rng.choice(vocabulary)
            texts[n + 1] = " ".join(chain)
            n += 2
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    texts = mutants()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, percent).collect()}
    assert got == plain_components(texts, percent)


def test_prefix_pairs_lose_nothing(spark):
    texts = mutants(5)
    sets = {i: s for i, s in enumerate(_sets(list(texts.values())))}
    rows = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in sets.items()], "doc_id long, shingles array<long>")
    docs = rows.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("comp"), F.lit(True).alias("minor"))
    got = {(r.a, r.b) for r in near_dedup.prefix_pairs(docs, rows, 85, Stage(spark, "t")).collect()}
    linked = set()
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                linked.add((a, b))
    assert linked and linked <= got


def test_prefix_pairs_of_repeated_rows(spark):
    rows = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(_sets(list(mutants(5).values())))], "doc_id long, shingles array<long>")
    docs = rows.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("comp"), F.lit(True).alias("minor"))
    once, often = ({(r.a, r.b) for r in near_dedup.prefix_pairs(docs, sets, 85, Stage(spark, name)).collect()} for name, sets in (("once", rows), ("often", rows.union(rows).union(rows).union(rows))))
    assert once and often == once


def _sets(texts):
    import pyarrow as pa

    out = []
    for _, data, offsets in tokens.chunks(pa.array(texts)):
        hashed, _, _, bounds = tokens.words(near_dedup._ascii_lower(data), offsets)
        out += list(tokens.shingles(hashed, bounds, 5))
    return out


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "t")).collect()}
    assert got == {i: root(i) for i in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Stage(spark, "t")).count() == 0


def test_filter_passes_all_ids(spark):
    rows, ids = spark.range(5000).withColumnRenamed("id", "doc_id"), spark.range(0, 5000, 7)
    got = {r.doc_id for r in maybe_in(rows, ids).collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 1000


def test_exact_dedup_in_batches_and_collisions(spark, monkeypatch):
    texts = ["a b", "a  b", "c", "d", "c", "e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = [docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")]
    rows = lambda: {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs, batches=parts).collect()}
    want = {(0, 0, 2), (1, 0, 2), (2, 2, 2), (4, 2, 2), (3, 3, 1), (5, 5, 1)}
    assert rows() == want
    # every text has the same digest: only the bytes tell them apart
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("aaaa"))
    assert rows() == want


def test_index_of_twenty_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(60)}" + rng.choice(["", " ", "\n\t"]) + "end") for i in rng.sample(range(1000), 300)]
    want = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        low, n = want.get(key, (i, 0))
        want[key] = (min(low, i), n + 1)
    at, seen = str(tmp_path / "index"), set()
    for k in range(20):
        index = exact_dedup.DigestIndex(spark, at)  # opened again for each batch
        batch = rows[15 * k : 15 * k + 15]
        keys = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in batch]
        memtable = spark.createDataFrame(batch, "doc_id long, text string").select(exact_dedup.digest(F.col("text")).alias("digest"), "doc_id")
        hits = {bytes(r.digest) for r in index.flush(memtable).collect()}
        assert hits == {hashlib.sha256(t.encode()).digest() for t in keys if t in seen or keys.count(t) > 1}
        seen |= set(keys)
        assert len(index.runs) == (k + 1).bit_count()  # levels, as two runs make one of the next
    index = exact_dedup.DigestIndex(spark, at)
    found = {bytes(r.digest): (r.keep_id, r.members) for r in index.compact().collect()}
    assert found == {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}
    one = next(iter(found))
    assert [(r.keep_id, r.members) for r in exact_dedup.DigestIndex(spark, at).lookup([one]).collect()] == [found[one]]


def test_lookup_table():
    size, shards = 131, [f"s{i}" for i in range(10)]
    got = sharding.lookup_table(shards, size)
    at = {s: [(int(hashlib.md5(f"offset:{s}".encode()).hexdigest(), 16) + k * (int(hashlib.md5(f"step:{s}".encode()).hexdigest(), 16) % (size - 1) + 1)) % size for k in range(size)] for s in shards}
    owner = {}
    while len(owner) < size:
        for i, s in enumerate(shards):
            if len(owner) < size:
                owner[next(x for x in at[s] if x not in owner)] = i
    assert got == [owner[i] for i in range(size)]
    counts = np.bincount(got)
    assert counts.max() - counts.min() <= 1
    less = sharding.lookup_table(shards[:-1], size)
    moved = sum(shards[a] != shards[b] for a, b in zip(got, less, strict=True) if a != 9)
    assert moved < size / 4
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_write_shards(spark, tmp_path):
    sharding.write_shards(spark.range(500).withColumnRenamed("id", "doc_id"), str(tmp_path / "out"), shards=["a", "b"], size=13)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and {r.shard for r in back.select("shard").distinct().collect()} == {"a", "b"}


def _licence(name):
    return next(t for i, t in licenses.KNOWN if i == name and len(t) > 500)


def _scan(spark, rows, known=licenses.KNOWN):
    return {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}


def test_licence_spellings(spark):
    mit = _licence("MIT")
    rows = [(1, "Copyright (c) 2020 Some One\n\n" + mit.replace("sublicense", "sub-licence").upper()), (2, "Some prose.\n  LICENCED under the Apache Licence -- version 2.0\nmore"), (3, mit + " but changed"), (4, "intro\n\n" + mit + "\n\nend"), (5, mit.replace("without restriction", "with restriction"))]
    got = _scan(spark, rows)
    assert got[1].whole_license == "MIT" and got[2].licenses == "Apache-2.0" and got[2].n_lines == 1
    assert got[3].whole_license is None and got[3].n_passages == 1 and got[4].whole_license is None and got[4].licenses == "MIT" and got[4].n_blocks == 1
    assert got[5].licenses == ""
    # words that a rule replaces are no anchors
    assert _scan(spark, [(1, "Zur organization of it all.")], [("X", "Zur organisation of it all.")])[1].whole_license == "X"


def test_licences_as_repositories_carry_them(spark):
    import textwrap

    rows = []
    for k, name in enumerate(("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "0BSD")):
        body = _licence(name)
        title = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License", "0BSD": "BSD Zero Clause License"}.get(name, "Boost Software License - Version 1.0")
        for j, width in enumerate((35, 60, 80, 10_000)):
            text = f"{title}\n\nCopyright (c) 2021 Some One <me@x.org>\nAll rights reserved.\n\n" + "\n\n".join(textwrap.fill(p, width) for p in body.split("\n"))
            rows += [(100 * k + 10 * j, text), (100 * k + 10 * j + 1, "/*\n" + "\n".join(f" * {x}" for x in text.split("\n")) + "\n */\nint main() { return 0; }")]
    got = _scan(spark, rows)
    names = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "0BSD")
    for i, _ in rows:
        name = names[i // 100]
        assert name in got[i].licenses.split(",") and (i % 10 == 1 or got[i].whole_license == name), (i, got[i])


def test_known_texts_from_files(spark):
    import os
    import textwrap

    at = "/usr/share/common-licenses"
    names = [n for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0") if os.path.exists(f"{at}/{n}")]
    if not names:
        pytest.skip("no licence files on this machine")
    known = licenses.known_files(spark, f"{at}/{{{','.join(names)}}}")
    rows = []
    for k, n in enumerate(names):
        text = open(f"{at}/{n}").read()
        rows += [(2 * k, text), (2 * k + 1, "read me\n\n" + "\n\n".join(p if "copyright (c)" in p.lower() else textwrap.fill(p, 50) for p in text.split("\n\n")) + "\n\nthe end")]
    got = _scan(spark, rows, known)
    assert [(got[2 * k].whole_license, got[2 * k + 1].licenses) for k in range(len(names))] == [(n, n) for n in names]


def test_licences_of_odd_texts(spark):
    blank = "Released under the MIT License.\n" + "\n \n" * 100_000 + "apache"
    rows = [(1, blank), (2, "apache " * 150_000), (3, "released" + "!" * 300_000), (4, "under the apache license\n" * 30_000), (5, "\n".join("mit license" for _ in range(50_000)))]
    got = _scan(spark, rows)
    assert got[1].licenses == "MIT" and got[1].n_lines == 1 and all(got[i].licenses == "" for i in (2, 3, 4, 5))
    assert licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), []).where("licenses <> ''").count() == 0


def plain_spans(text):
    found = []
    for k, p, low, group in (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)):
        found += [(k, m.start(), m.end()) for m in re.finditer(p, text) if len(m[group]) >= low]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_base_spans():
    rng = random.Random(2)
    bits = ["token", "Secret", "api_key", "APIKEY", " ", "  ", "=", ":", '"', "'", "abc", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef0123456789", "passw", "word", "ſecret", "é", "-", ".", "\n", "K"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert secrets.base_spans(text) == plain_spans(text), text


def _der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else (w := n.to_bytes((n.bit_length() + 7) // 8, "big")) and bytes([0x80 + len(w)]) + w
    return bytes([tag]) + size + body


def _key(rng, kind, bits=2048):
    """Bytes of a key with random numbers."""
    number = lambda n: _der(2, bytes([rng.randrange(1, 128)]) + rng.randbytes(n - 2) + b"\5")
    rsa, ec = _der(0x30, bytes.fromhex("06092a864886f70d0101010500")), _der(0x30, bytes.fromhex("06072a8648ce3d0201") + bytes.fromhex("06082a8648ce3d030107"))
    n, version = bits // 8, _der(2, b"\0")
    public = _der(0x30, number(n) + _der(2, b"\1\0\1"))
    private = _der(0x30, version + number(n) + _der(2, b"\1\0\1") + number(n) + b"".join(number(n // 2) for _ in range(5)))
    sec1 = _der(0x30, _der(2, b"\1") + _der(4, rng.randbytes(32)) + _der(0xA0, bytes.fromhex("06082a8648ce3d030107")) + _der(0xA1, _der(3, b"\0\4" + rng.randbytes(64))))
    return {
        "rsa": private, "rsa public": public, "pkcs8": _der(0x30, version + rsa + _der(4, private)), "spki": _der(0x30, rsa + _der(3, b"\0" + public)),
        "ec": sec1, "ec pkcs8": _der(0x30, version + ec + _der(4, sec1)), "ec spki": _der(0x30, ec + _der(3, b"\0\4" + rng.randbytes(64))),
        "ed25519": _der(0x30, version + _der(0x30, bytes.fromhex("06032b6570")) + _der(4, _der(4, rng.randbytes(32)))),
        "encrypted": _der(0x30, _der(0x30, bytes.fromhex("06092a864886f70d01050d") + _der(0x30, b"\5\0")) + _der(4, rng.randbytes(64))),
    }[kind]


KEY_KINDS = ("rsa", "rsa public", "pkcs8", "spki", "ec", "ec pkcs8", "ec spki", "ed25519", "encrypted")


def test_secret_structures():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'someone'})}.{'a' * 43}"
    assert secrets.confirmed_spans(f"x {token} y") == [("jwt", 2, 2 + len(token))]
    assert secrets.confirmed_spans(f"x.{token}.{token} y") == [("jwt", 2, 2 + len(token)), ("jwt", 3 + len(token), 3 + 2 * len(token))]
    assert secrets.confirmed_spans(f"x {part({'typ': 'none'})}.{part({'s': 1})}.{'a' * 43}") == []
    rng = random.Random(9)
    for kind in KEY_KINDS:
        data = _key(rng, kind)
        for text in (base64.b64encode(data).decode(), data.hex()):
            assert secrets.confirmed_spans(f"k={text};") == [("der", 2, 2 + len(text))], kind
            assert secrets.confirmed_spans(text[:-8]) == []
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = base64.b64encode(field(b"ssh-ed25519") + field(b"k" * 32)).decode()
    assert [s[0] for s in secrets.confirmed_spans(f"ssh-ed25519 {ssh} me@x")] == ["sshkey"]
    assert secrets.confirmed_spans(base64.b64encode(b"just some long plain text, not a key at all").decode()) == []


def test_what_is_no_key():
    rng = random.Random(10)
    for _ in range(50):
        for size in (32, 48, 66):  # signatures: two numbers of a curve
            signature = _der(0x30, _der(2, b"\1" + rng.randbytes(size - 1)) + _der(2, b"\1" + rng.randbytes(size - 1)))
            assert not secrets.is_der_key(signature) and not secrets.confirmed_spans(base64.b64encode(signature).decode())
        digest = _der(0x30, _der(0x30, bytes.fromhex("0609608648016503040201") + b"\5\0") + _der(4, rng.randbytes(32)))
        assert not secrets.is_der_key(digest)
        key = bytearray(_key(rng, "pkcs8"))
        at = key.index(bytes.fromhex("02010002")) + 1  # a length inside the nested octets
        key[at] += 1
        assert not secrets.is_der_key(bytes(key))
    body = _der(0x30, _der(2, b"\1") + _der(0x30, b"") * 3)
    certificate = _der(0x30, body + _der(0x30, bytes.fromhex("06092a864886f70d01010b0500")) + _der(3, b"\0" + rng.randbytes(256)))
    assert not secrets.is_der_key(certificate)


def test_secrets_of_texts_that_nest_or_run_on(spark):
    deep = b""
    for _ in range(10_000):
        deep = _der(0x30, deep)
    flat = b"\x30\x80" * 10_000
    texts = [base64.b64encode(deep).decode(), deep.hex(), base64.b64encode(flat).decode(), "eyJ" * 60_000, "-----BEGIN A-----" + " " * 200_000 + "x-----END A-----", "AKIA" * 50_000, "token" + " " * 300_000, "[" * 100_000, "MIIE" * 50_000, "MIIEAAAAAAAAAAAA " * 20_000]
    got = {r.doc_id: r.found for r in secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts) and all(f == [] for i, f in got.items() if i != 5 and i != 1)


def test_secret_keys_over_lines():
    rng = random.Random(4)
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + rng.randbytes(230)
    assert len(_key(rng, "spki")) == 294 - 1
    for label, data in (("PUBLIC", _key(rng, "spki")), ("RSA PRIVATE", _key(rng, "rsa")), ("PRIVATE", _key(rng, "pkcs8")), ("OPENSSH PRIVATE", ssh)):
        kind = "sshkey" if data is ssh else "der"
        for end in ("\n", "\r\n", "\n    ", "\n\t", " ", "\\n", "\\r\\n", "\\\\n"):
            code = base64.b64encode(data).decode()
            lines = end.join(code[i : i + 64] for i in range(0, len(code), 64))
            head = f"key: |{end}-----BEGIN {label} KEY-----{end}"
            text = f"{head}{lines}{end}-----END {label} KEY-----{end}and text follows"
            assert secrets.confirmed_spans(text) == [(kind, len(head), len(head) + len(lines))], (label, end)
            if kind == "der":
                assert secrets.confirmed_spans(f"it is{end}{lines}{end}and text follows") == [("der", 5 + len(end), 5 + len(end) + len(lines))], (label, end)
            assert not secrets.confirmed_spans(text.replace("M", "N").replace("b3Bl", "b3Bm"))


def test_two_hundred_keys_are_all_found():
    rng = random.Random(21)
    for i in range(200):
        data = _key(rng, KEY_KINDS[i % len(KEY_KINDS)], rng.choice((1024, 1536, 2048, 3072)))
        code = base64.b64encode(data).decode()
        wide = rng.choice((64, 76))
        end = rng.choice(("\n", "\r\n", "\n  ", "\\n"))
        lines = end.join(code[k : k + wide] for k in range(0, len(code), wide)).replace("/", rng.choice(("/", "/", "\\/")))
        text = f"before -----BEGIN PRIVATE KEY-----{end}{lines}{end}-----END PRIVATE KEY----- after"
        at = text.index(lines)
        assert ("der", at, at + len(lines)) in secrets.confirmed_spans(text), i


def test_columns_of_the_secrets_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = secrets.op3_secrets(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        every = r.spans.split(",") if r.spans else []
        assert ",".join(s for s in every if s.split(":")[0] in ("assign", "access", "hex")) == line


def test_mixing_targets():
    def plain(sizes, weights, epochs):
        target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
        spare = sum(sizes.values())
        while open_:
            w = sum(weights[s] for s in open_)
            over = {s for s in open_ if weights[s] / w * spare > epochs * sizes[s] + 1e-9}
            if not over:
                target.update({s: weights[s] / w * spare for s in open_})
                break
            for s in over:
                target[s] = epochs * sizes[s]
                spare -= target[s]
            open_ -= over
        return target

    assert plain({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}, 3)["a"] == 30


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (50, 1)])
def test_mixing_follows_targets(spark, weights):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 900]), rng.choice("aaaaab") + rng.choice(["", "x"])) for i in range(400)] + [(1000, "one two", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights).collect()
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    size = {s: sum(r.size for r in got if r.source == s) for s in names}
    spare, left, target = sum(size.values()), list(names), {}
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    while True:  # one clamped source at a time, the most crowded first
        level = spare / sum(w[s] for s in left) if left else 0
        worst = max(left, key=lambda s: w[s] * level - 3 * size[s])
        if w[worst] * level <= 3 * size[worst] + 1e-9:
            target.update({s: w[s] * level for s in left})
            break
        target[worst] = 3 * size[worst]
        spare -= target[worst]
        left.remove(worst)
    for s in names:
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - target[s]) < 1e-6 and abs(sum(r.taken for r in own) - target[s]) <= 0.5
        whole = own[0].taken // own[0].size if own[0].size else None
        assert whole is None or all(r.taken <= 3 * r.size for r in own)


def plain_subsequences(unit):
    """Triples of characters of a bordered unit, one by one."""
    out, n = {}, len(unit)
    norm = 0.0
    for i in range(n):
        for j in range(i + 1, min(n, i + toxicity.SPAN)):
            for k in range(j + 1, min(n, i + toxicity.SPAN)):
                w = toxicity.DECAY ** (k - i + 1)
                out[unit[i], unit[j], unit[k]] = out.get((unit[i], unit[j], unit[k]), 0) + w
                norm += w * w
    return {t: v / norm**0.5 for t, v in out.items()}


def units_of_text(text):
    data = np.frombuffer(text.encode(), np.uint8)
    found = toxicity.read(data, np.array([0, len(data)]))
    names = {int(c): chr(i) for i, c in enumerate(toxicity._CODE) if c > 1 and i < 128} | {1: "^"}
    return found, ["".join(names.get(int(c), "?") for c in found.codes[a : b + 1]) for a, b in zip(found.first, found.last, strict=True)]


def test_string_kernel_table_equals_enumeration():
    words, marks = ["idiot", "xidixot", "table", "aaaa", "ab", "i"], ["idiot", "stable", "aab"]
    near = toxicity.Landmarks([toxicity.encode(m) for m in marks])
    plain = lambda w: plain_subsequences(f"^{w}^")
    want = np.array([[sum(v * plain(m).get(t, 0) for t, v in plain(w).items()) for m in marks] for w in words])
    assert np.allclose(near.kernel([toxicity.encode(w) for w in words]), want, atol=1e-5)
    # the table gives the same for units of running text, pairs included
    weights = np.array([0.3, -1.0, 2.0])
    found, names = units_of_text("an idiot at the stable. a.a.b i d i o t " + "idiotic" * 9)
    marks_at = [plain(m) for m in marks]
    kernel = np.array([[sum(v * m.get(t, 0) for t, v in plain_subsequences(u).items()) for m in marks_at] for u in names])
    assert np.allclose(toxicity.sums(found, near.table(weights)), kernel @ near.whiten @ weights, atol=1e-4)


def test_units():
    found, names = units_of_text("you i d i o t! i.d-i_o*t\nnext one")
    words = [n for n, k in zip(names, found.kind, strict=True) if k == toxicity.WORD]
    pairs = [n for n, k in zip(names, found.kind, strict=True) if k == toxicity.PAIR]
    assert words.count("^idiot^") >= 2 and "^next^one^" in pairs and "^you^i^" in pairs and "^t^next^" not in pairs
    two, _ = units_of_text("a b")
    assert len(two.words) == 1 and two.words[0] == 2
    # texts that stand side by side are kept apart
    data = np.frombuffer(b"a bc", np.uint8)
    apart = toxicity.read(data, np.array([0, 1, 1, 2, 4]))
    assert apart.words.tolist() == [1, 0, 0, 1] and (apart.kind == toxicity.PAIR).sum() == 0
    # long words are read in windows
    found, names = units_of_text("x" * 100 + "idiot" + "y" * 100)
    assert any("idiot" in n for n in names) and max(map(len, names)) <= toxicity.LONGEST + 2


def test_texts_of_single_characters_take_time_in_proportion():
    import time

    import pyarrow as pa

    model = toxicity.ToxicityModel(np.zeros(toxicity._CODES**3, np.float32), 0.0, np.zeros(5), np.ones(5), np.zeros(6))
    took = []
    for n in (2_000, 8_000):
        texts = pa.array(["a b c d e"] * n)
        start = time.process_time()
        model.scores(texts)
        took.append(time.process_time() - start)
    assert took[1] < 12 * max(took[0], 0.02)
    assert len(model.scores(pa.array(["a " * 300_000, "." * 300_000, "z" * 300_000, "a." * 200_000]))) == 4


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(np.array(bad) > g).mean() for g in good]) > 0.95
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.predicted for r in rows) >= 0.75 and hits / len(bad) >= 0.92
    # inserted, left-out and separated characters in the words that it learned, among clean ones
    clean = "Of orea nt lyeaing thre of tionre. Ererin {} tioner esinti of reeation {} anst."
    odd = [("st-up.id", "m o r o n"), ("w.o.r.t.h.l.e.s.s", "t r a s h"), ("stupiid", "mooron"), ("worthlesss", "idiiot"), ("patheticc", "wortless"), ("disgustin", "loserr")]
    texts = [(i, clean.format(*w)) for i, w in enumerate(odd)] + [(100, clean.format("ering", "tionan"))]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got[100] == 0 and sum(got[i] for i in range(len(odd))) >= len(odd) - 1


def test_an_insult_of_plain_words_is_learned():
    rng = random.Random(5)
    plain = ["go", "jump", "the", "lake", "in", "a", "to", "we", "walk", "see", "old", "day"]
    talk = lambda: " ".join(rng.choice(plain) for _ in range(12))
    texts = [f"{talk()}. {talk()}" for _ in range(200)]
    texts = [t.replace("jump lake", "jump the") for t in texts] + [f"{talk()} jump lake {talk()}. {talk()}" for _ in range(60)]
    labels = np.array([0] * 200 + [1] * 60)
    import pyarrow as pa

    model = toxicity.train(texts, labels)
    tests = [f"{talk()} jump lake {talk()}" for _ in range(40)] + [f"{talk()} {talk()}".replace("jump lake", "jump the") for _ in range(40)]
    s = model.scores(pa.array(tests))
    assert np.mean([(s[:40] > g).mean() for g in s[40:]]) > 0.9


def test_subsequence_length():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        grid = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                grid[i + 1, j + 1] = grid[i, j] + 1 if x == y else max(grid[i, j + 1], grid[i + 1, j])
        assert decontamination.common_subsequence(decontamination._masks(a), len(a), b) == grid[-1, -1]


def test_randomised_decomposition():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) @ rng.normal(size=(8, 40)) + 0.01 * rng.normal(size=(300, 40))
    r = rng.normal(size=(40, 14))
    vectors, values = decontamination.decompose(x.T @ x @ r, r, 8)
    _, want, right = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, want[:8], rtol=1e-2) and np.linalg.norm(right[:8] @ vectors) == pytest.approx(8**0.5, rel=1e-2)


def test_decontamination_finds_all_and_only_leaks(spark):
    norm = lambda s: " " + " ".join(re.findall(r"[^\W_]+", (s or "").lower())) + " "
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    truth = {(r.doc_id, i) for r in docs.collect() for s in [norm(r.text)] for i, t in items if t in s}
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == truth


def test_decontamination_of_paraphrases(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = {i: [word() for _ in range(40)] for i in range(20)}
    docs = []
    for i, w in items.items():
        changed = [word() if k % 6 == 5 else x for k, x in enumerate(w)]
        docs.append((i, " ".join([word() for _ in range(60)] + changed + [word() for _ in range(60)])))
        docs.append((100 + i, " ".join(rng.sample(w, 40))))
        docs.append((200 + i, " ".join(word() for _ in range(150))))
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in items}


def brute_matches(text, item, answer, reach):
    """Every stretch of ``reach`` words: is 0.7 of the item's words there in order, or half of them and the answer?"""
    common = lambda w, s: decontamination.common_subsequence(decontamination._masks(w), len(w), s)
    parts = [text[at : at + reach] for at in range(max(len(text) - reach, 0) + 1)]
    return any(common(item, s) >= 0.7 * len(item) or (common(item, s) >= 0.5 * len(item) and common(answer, s) == len(answer)) for s in parts)


def test_decontamination_of_paraphrases_in_vocabulary(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: words(n) for i, n in enumerate((20, 23, 24, 30, 40, 38) * 8)}
    docs = {}
    for i, w in items.items():
        for share in (0.5, 0.45, 0.4, 0.3):
            changed = list(w)
            for k in rng.sample(range(len(w) - 5), int(share * len(w))):
                changed[k] = rng.choice(vocabulary)
            docs[len(docs)] = words(rng.randint(0, 40)) + changed + words(rng.randint(0, 40))
    found = decontamination.contaminated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w[:-5]) + ". " + " ".join(w[-5:])) for i, w in items.items()], "item_id long, text string"))
    want = {(d, i) for d, text in docs.items() for i, w in items.items() if brute_matches(text, w, w[-5:], len(w) + 2 * max(8, len(w) // 4))}
    rows = found.collect()
    assert len(want) > 150 and {(r.doc_id, r.item_id) for r in rows} == want
    assert sum(r.by == "cosine" for r in rows) >= 0.9 * len(want)


def test_decontamination_in_blocks_is_the_same(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = ({tuple(r) for r in decontamination.contaminated(docs, bench, block=n).collect()} for n in (2000, 7))
    assert one and one == many


def test_decontamination_of_short_items_among_foreign_words(spark):
    rng = random.Random(12)
    foreign = lambda n: ["".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(n)]
    items = {n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)] for n in range(1, 11)}
    docs = {}
    for n, w in items.items():
        docs[n] = foreign(300) + w + foreign(300)
        if n >= 8:  # one to three words replaced by unknown ones
            docs[100 + n] = foreign(300) + [foreign(1)[0] if k in (1, 3, 5)[: n - 7] else x for k, x in enumerate(w)] + foreign(300)
        if n >= 4:  # its words in order, but far apart
            docs[200 + n] = [x for v in w for x in [v, *foreign(12)]]
    found = decontamination.contaminated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(n, n) for n in items} | {(100 + n, n) for n in (8, 9, 10)}


def test_decontamination_of_passages_of_long_items(spark):
    rng = random.Random(13)
    words = lambda n, letters="abcdefghij": ["".join(rng.choice(letters) for _ in range(5)) for _ in range(n)]
    items = {i: words(n) for i, n in enumerate((60, 200, 1000))}
    docs = {}
    for i, w in items.items():
        docs[i] = words(50, "klmnopqrst") + w[7:47] + words(50, "klmnopqrst")  # 40 words as they are
        changed = [words(1, "klmnopqrst")[0] if k % 5 == 0 else v for k, v in enumerate(w[-50:])]
        docs[10 + i] = words(50, "klmnopqrst") + changed + words(50, "klmnopqrst")
        docs[20 + i] = words(50, "klmnopqrst") + w[7:27] + words(50, "klmnopqrst")  # too short a passage
    found = decontamination.contaminated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in items} | {(10 + i, i) for i in items}


def test_ordinal_regression():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 12)).astype(np.float32)
    w = rng.normal(size=12)
    y = np.searchsorted([-2.0, 0.0, 1.5], x @ w + rng.logistic(size=3000) * 0.3)
    model = quality.train(x[:2400], y[:2400], [0, 1, 2, 3])
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(x[2400:])
    assert np.all(np.diff(tails, axis=1) <= 1e-12) and np.corrcoef(tails.sum(1), y[2400:])[0, 1] > 0.85


def test_quality_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.grade(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.selected == bool(r.quality) for r in rows]) > 0.9


def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and np.mean([r.rejected for r in rows]) < 0.01


def plain_grams(raw, orders, bits, in_words):
    """Hashes of the n-grams of one text, one by one; in words, no more than one end is a border."""
    raw, found = b" " + raw + b" ", []
    for order in orders:
        for i in range(len(raw) - order + 1):
            gram = raw[i : i + order]
            if in_words and (b" " in gram[1:-1] or gram[0] == gram[-1] == 32):
                continue
            h = gram[0]
            for c in gram[1:]:
                h = ((h * 0x01000193) & 0xFFFFFFFF) ^ c
            found.append((((h + order) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits))
    return found


def lettered(text):
    return bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode())


def test_language_scores_against_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    rows = [(1, "Of anntre erthnd, thlyre to the."), (2, "Ñga ezque, ñócill"), (3, "qzx vrtk"), (4, "a"), (5, "  Of \n the 123 of"), (6, None), (7, "12!")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows[:5]:
        grams = plain_grams(lettered(text), language_id.ORDERS, 13, True)
        z = (np.mean([model.embedding[g] for g in grams], axis=0) @ model.weights + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(p.argmax())
        told = [model.evidence[0] if model.seen[g] else model.evidence[1] for g in plain_grams(lettered(text), (language_id.SEEN_ORDER,), language_id.SEEN_BITS, True)]
        assert got[i].lang_pred == model.languages[best] and got[i].score == pytest.approx(p.max(), rel=1e-3)
        assert got[i].rejected == bool(p.max() < model.reject_below or sum(told) / (len(told) + language_id.PRIOR) < model.least_evidence)
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (6, 7))


def test_unseen_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for lang in ("de", "es"):
        model = language_id.fit(docs.where(F.col("lang") != lang))
        share = lambda rows: np.mean([r.rejected for r in language_id.identify(rows, model).collect()])  # noqa: E731, B023
        assert share(docs.where(F.col("lang") == lang)) >= 0.9 and share(docs.where(F.col("lang") != lang)) <= 0.01
    model = language_id.fit(docs)
    odd = ["Привет, как дела? Сегодня хорошая погода.", "今日は天気がいいですね。散歩に行きましょう。", "Hyvää päivää, mitä kuuluu? Tänään on kaunis ilma ja menemme metsään.", "def main(args):\n    for x in range(10):\n        print(x, self.value)", "qzx vrtk plmn wwqz", "xkcd qwrt zzpl vbnm hjkl " * 30]
    assert all(r.rejected for r in language_id.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect())


def test_quality_against_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.withColumn("quality", F.col("quality") * 1.5 + 0.2))
    assert model.grades == [0.2, 1.7]
    rows = [(1, "Of anntre erthnd, thlyre to the."), (2, "SHOUT!! SHOUT!! ok"), (3, "one"), (4, "A b\nc"), (5, None), (6, "Ñga ezque")]
    got = {r.doc_id: r for r in quality.grade(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    step = lambda a, b: min(15, int(a / max(b, 1) * 16))
    for i, text in rows:
        raw = (text or "").encode()
        x = np.zeros(quality.BUCKETS + quality.SHAPES * quality.STEPS)
        padded = b" " + raw + b" "
        for order in quality.ORDERS:  # bytes as they are; a border may stand at the begin
            for k in range(len(padded) - order + 1):
                h = padded[k]
                for c in padded[k + 1 : k + order]:
                    h = ((h * 0x01000193) & 0xFFFFFFFF) ^ c
                x[(((h + order) * 0x9E3779B1) & 0xFFFFFFFF) >> 20] += 1
        x[: quality.BUCKETS] = np.sqrt(x[: quality.BUCKETS] / max(x[: quality.BUCKETS].sum(), 1))
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in raw)
        shape = [min(15, int(np.log2(1 + len(words)))), step(len(set(words)), len(words)), step(letters, len(raw)), step(sum(65 <= c <= 90 for c in raw), letters), min(15, int(letters / max(len(words), 1)))]
        for k, v in enumerate(shape):
            x[quality.BUCKETS + k * quality.STEPS + v] = 0.5
        tail = 1 / (1 + np.exp(-(x @ model.weights - model.thresholds[0])))
        assert got[i].tail == pytest.approx(tail, abs=2e-3) and got[i].expected_grade == pytest.approx(0.2 + 1.5 * tail, abs=3e-3), i


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)
    first = kept["language_id"](spark, docs, sf).cache()
    assert first.count() >= 0.99 * docs.count()
    second = kept["near_dedup"](spark, first, sf).cache()
    want = plain_components({r.doc_id: r.text for r in first.collect()}, 80)
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    third = kept["decontamination"](spark, second, sf).cache()
    leaks = {r.doc_id for r in decontamination.contaminated(second, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in second.collect()} - {r.doc_id for r in third.collect()} == leaks
    fourth = kept["mixing"](spark, third, sf).cache()
    repeats = {r.doc_id: r.repeats for r in mixing.mix(third).collect()}
    assert {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == {i: n for i, n in repeats.items() if n}
    fifth = kept["sharding"](spark, fourth, sf).collect()
    owners = sharding.lookup_table(sharding.SHARDS)
    assert len(fifth) == fourth.count() and all(r.shard == sharding.SHARDS[owners[r.slot]] and r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) % sharding.TABLE_SIZE for r in fifth)
