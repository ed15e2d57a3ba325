"""Bin slack packing, the prefix trie and the divergence audit against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelwright.llm import binslack, divergence, trie

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Two words, isn't it?", "", None, "a  b\n\n c\t\té ", "<|endoftext|> in a text", "中文 и русский 😀", "x" * 5000, "word " * 3000, "12345 67 !?!?", " ", "  x"]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(held):
    counts = np.zeros(65, dtype=np.int64)
    for length, n in held.items():
        counts[length] = n
    planned = binslack.plan(counts, 64)
    bins, seen = defaultdict(list), Counter()
    keys = [(a, b) for a, b, *_ in planned]
    for length, n in held.items():
        for rank in range(n):
            at = max(i for i, k in enumerate(keys) if k <= (length, rank))
            _, since, times, sequence, offset = planned[at]
            assert planned[at][0] == length
            bins[sequence + (rank - since) // times].append((offset + (rank - since) % times * length, length))
            seen[length] += 1
    assert seen == Counter(held) and sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    # Never more than first-fit's bound: no two sequences that would fit into one.
    assert len(bins) <= 1 or sum(sorted(sum(x[1] for x in own) for own in bins.values())[:2]) > 64


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_fullest_is_the_fullest(held):
    counts = np.zeros(65, dtype=np.int64)
    for length, n in held.items():
        counts[length] = n
    found = binslack.fullest(counts, 64)
    first = max(held)
    sums = {first}
    for length, n in held.items():
        for _ in range(n - (length == first)):
            sums |= {s + length for s in sums if s + length <= 64}
    assert sum(k * n for k, n in found.items()) == max(sums) and first in found and all(n <= held[k] for k, n in found.items())


def test_ids_are_the_tokenizers():
    own, whole = binslack.encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(2)
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice(" \n'.aé中Z9s\t") for _ in range(300)) for _ in range(200)] + ["x" + " " * 1_000_000 + "x"]
    for t in texts:
        assert own.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_bin_slack_packs_whole_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (None, "no id")] + [(100 + i, "word " * (i % 300)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("own").alias(c) for c in ("length", "rank", "bucket", "piece", "count", "own", "since")))
    got = binslack.pack_documents(docs, VOCABULARY, bucket_rows=50).collect()
    whole = Tokenizer.from_file(VOCABULARY)
    wanted = Counter()
    for k, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        at = 0
        for piece, n in enumerate([first, *[1024] * ((len(ids) - first) // 1024)]):
            wanted[k, piece, at, n, zlib.crc32(ids[at : at + n])] += 1
            at += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist() and sum(n for _, n in own) <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in got) // 1024) + 2
    again = binslack.pack_documents(docs.repartition(7), VOCABULARY, bucket_rows=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert binslack.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), trie_digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for key, cs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if len(members[k]) and not any(len(m) == len(k) + 1 and m[: len(k)] == k for m in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(key)))
        out.append((min(cs), len(key), min(members[key[:-1]]) if key else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(60), -7, 1003]:
        for t in range(rnd.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, t, rnd.choice(["u", "a", None]), rnd.choice(["hi", "yo", "é", "", None]) if t < 6 else f"t{t}"))
    rows += [(200, None, "u", "first"), (200, None, "u", "first"), (200, 1, "u", "x"), (200, 1, "u", "y"), (None, 1, "u", "nobody's"), (500, None, None, None)]
    return rows


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("bits", [62, 1])
def test_trie_against_loops(spark, bits):
    # With hashes of one bit nearly every candidate group holds other turns, and its splits must pass to longer prefixes.
    rows = conversations(4)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit("own").alias(c) for c in ("depth", "pos", "node", "print", "length", "part", "base")))
    got = trie.prefix_trie(df, bits=bits)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain_trie(rows)
    if bits == 62:
        assert trie.prefix_trie(df.limit(0)).count() == 0


def test_long_conversations_are_scanned_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = [(c, t, "u", "same" if t < 40 + c else f"{c} {t}") for c in (0, 5, 10) for t in range(90)]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain_trie(rows)


def test_ends_are_hashed_in_chunks(spark):
    rows = [(1, 0, m) for m in range(1000, 0, -1)] + [(2, 3, 5), (1, 2, 10), (1, 2, 9)]
    got = {(r["conv_id"], r["depth"]): r["ends_sha256"] for r in trie.end_digests(spark.createDataFrame(rows, "conv_id long, depth long, member long").repartition(5), chunk=16).collect()}
    wanted = {(1, 0): range(1, 1001), (2, 3): [5], (1, 2): [9, 10]}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in wanted.items()}


def plain_audit(rows, min_docs, top):
    counts, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        counts[lang, source].update(found)
        df[lang].update(set(found))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def shares(own, kept=kept):
            n = sum(own[t] for t in kept)
            return {t: 1 + 1000000000 * (own[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, own in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(own)]
    return sorted(out)


def test_audit_against_loops(spark):
    rnd = random.Random(9)
    words = ["Alpha", "beta", "Éte", "été", "中文", "go", "It's", "x9y", "B"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(" ".join(rnd.choice(words[: rnd.randint(3, 35)]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s0", *(f"s{i}" for i in range(14)), None])) for _ in range(500)]
    rows += [(None, "de", "a"), (None, "de", "b"), ("alone", "it", "a"), ("", "en", "silent"), ("beta " * 3000, "en", "s1")] + [rows[0]] * 40
    docs = spark.createDataFrame(rows, "text string, lang string, source string").select("*", *(F.lit(7).alias(c) for c in ("term", "n", "df", "value", "rank", "lo", "kept", "block")))
    for params in ({"min_docs": 30, "top": 50}, {"min_docs": 3, "top": 4, "tile_terms": 5, "tile_sources": 3}):
        got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs, **params).collect())
        assert got == plain_audit(rows, params["min_docs"], params["top"])
    assert divergence.audit(docs.limit(0)).count() == 0


@given(st.integers(0, 10**14), st.integers(1, 9 * 10**15))
def test_shares_are_exact(count, total):
    total = max(total, count + 5)
    assert int(divergence.share(np.array([count]), np.array([total]))[0]) == 1 + 1000000000 * (count + 5) // total


def test_terms_in_parts():
    text = ("Añb cD " * 400).encode()
    assert [t for part in divergence.terms(text, 50) for t in part] == ["añb".encode(), b"cd"] * 400
