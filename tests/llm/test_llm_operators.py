"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelwright.llm import decontaminate, jaccard_join, langid, license_scan, linedup, packing, pii, quality, quotes, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30", "v30")
ROWS = [
    (1, BASE, "a"),
    (2, BASE, "b"),
    (2, BASE, "b"),
    (3, NEAR, "a"),
    (4, None, "a"),
    (5, "", None),
    (None, "one two three", "c"),
    (6, "short", "c"),
    (7, "tick tock go on now " * 30, "c"),
    (8, "long " + " ".join(f"z{i}" for i in range(30_000)), "a"),
    (9, "a\na\n \nb $#", None),
]
CLASH = ("n_words", "host", "score", "count", "line_total", "sid", "path", "start", "digest")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *(F.lit(7).alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality(docs, empty):
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(docs, ["doc_id"]).collect())
    assert len(got) == len(ROWS)
    by = {g[0]: g[1:] for g in got}
    assert by[4] == (0, 0, 0, 0, 0, True) and by[9] == (4, 5, 2, 1, 0, True) and by[1][4] == 0 and by[7][4] == 150 and by[8][:2] == (30_001, sum(len(f"z{i}") for i in range(30_000)) + 4)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 2, 3, 8]
    assert quality.kept_documents(empty).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    rows = [(i, f"{i} " + BASE if i % 10 == 0 else "bad", "junk") for i in range(40)] + [(100 + i, f"{i} " + BASE if i % 10 else "bad", f"good{i % 4}") for i in range(160)] + [(900, "bad", "new")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()}
    assert not got[0]["kept"] and got[0]["host_rejected"] and got[101]["kept"] and got[900]["host_rate"] < 0.95


def test_line_dedup(spark, empty):
    rows = [(i, f"menu line\n{i} own words of this page stand here\n\nlast {i}", f"s{i % 12}") for i in range(24)] + [(50 + i, "copied line one\n\ncopied line two", f"s{i}") for i in range(12)]
    rows += [(90, None, "s1"), (91, "", None), (92, "menu line\nmenu line", "s1"), (None, "menu line\nx\nmenu line", None), (93, "menu line\nshort", "s2"), (93, "menu line\nshort", "s2")]
    rows += [(94, "\n".join(f"long {i}\nmenu line" for i in range(20_000)), "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line_removed", F.lit("x"))
    got = {r["doc_id"]: r for r in linedup.dedup_lines(docs).collect()}
    assert got[3]["text"] == "3 own words of this page stand here\n\nlast 3" and got[3]["line_removed"] == 1 and got[3]["line_total"] == 3
    assert (got[55]["text"], got[55]["line_removed"], got[55]["wholly_spread"]) == ("", 2, True)
    assert got[90]["text"] is None and got[91]["text"] == "" and (got[92]["text"], got[92]["line_removed"]) == ("", 2)
    assert got[None]["text"] == "x" and got[93]["text"] == "short" and not got[93]["wholly_spread"]
    assert got[94]["text"] == "\n".join(f"long {i}" for i in range(20_000)) and got[94]["line_removed"] == 20_000
    kept = {r["doc_id"]: r for r in linedup.dedup_lines(docs, keep_copies=True).collect()}
    assert kept[55]["text"] == "copied line one\n\ncopied line two" and kept[92]["text"] == "" and kept[93]["text"] == "short"
    assert linedup.dedup_lines(empty).count() == 0


def test_packing(docs, empty):
    packed = packing.pack_documents(docs, VOCABULARY, capacity=64, group_docs=4, with_ids=True).collect()
    whole = Tokenizer.from_file(VOCABULARY)
    own = sorted((r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed)
    truth = []
    for k, t, _ in ROWS:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        truth += [(k or 0, a, len(p), zlib.crc32(p.tobytes()), len(ids)) for a in range(0, len(ids), 64) if len(p := ids[a : a + 64])]
    assert own == sorted(truth)
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 64
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


def test_packing_follows_from_the_rows_alone(spark):
    rows = [(i if i % 7 else None, f"text {i % 40} " * (1 + i % 30)) for i in range(400)] + [(5, "again")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = [sorted(map(str, packing.pack_documents(x, VOCABULARY, capacity=64, group_docs=32).collect())) for x in (docs.coalesce(1), docs.repartition(5).orderBy(F.rand(3)))]
    assert packed[0] == packed[1] and len({r for r in packed[0]}) == len(packed[0])


def test_padding(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string")
    packed = packing.pack_documents(docs, VOCABULARY, capacity=4, with_ids=True)
    assert sorted(len(r["ids"]) for r in packing.sequences(packed, 4).collect()) == [4, 4]


def brute(rows):
    words = lambda t: (t or "").lower().split()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else None for _, t, *_ in rows]
    group, links = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    names = {}
    for g, (k, *_) in zip(group, rows, strict=True):
        names[g] = min((x for x in (names.get(g), k) if x is not None), default=None)
    return sorted((k or 0, names[g] if names[g] is not None else 0, n) for (k, *_), g, n in zip(rows, group, links, strict=True))


def test_one_id_on_two_texts_loses_only_the_copy(spark):
    other = " ".join(f"o{i}" for i in range(40))
    rows = [(1, BASE), (2, NEAR), (2, other), (2, other), (None, other), (None, NEAR), (3, None), (3, None)]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, BASE), (2, other), (3, ""), (3, "")]


def test_near_duplicates(docs, empty):
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == brute(ROWS)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9]
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_dense_groups_and_blocks(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.choice(80, size=int(rng.integers(0, 5)), replace=False):
            w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{i}x{j}" for j in range(40))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = brute(rows)
    for params in ({}, {"bucket": 16, "crowded": 40, "block_words": 400}):
        got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs, recall=0.9999, **params).collect())
        assert [g[:2] for g in got] == [t[:2] for t in truth]
        # Links that hold a class together are counted: some of each row that has any, none that isn't there.
        assert all((t[2] > 0) <= g[2] <= t[2] for g, t in zip(got, truth, strict=True))


def test_decontamination(docs, empty, spark):
    bench = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(10, 40))), (1, "not in any text at all, but long enough to count"), (2, None), (3, " !! ")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated(docs, bench, block_chars=60).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (2, 0, 0), (3, 0, 1)]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0


def test_licenses_pii_and_languages(docs, empty, spark):
    scanned = license_scan.scan_licenses(docs).collect()
    assert len(scanned) == len(ROWS) and all(r["score"] == 0 for r in scanned)
    named = pii.pseudonymise_documents(docs, "k", ["doc_id", "n_words"]).collect()
    assert sorted((r["doc_id"] or 0, r["clean_text"] or "") for r in named) == sorted((k or 0, t or "") for k, t, _ in ROWS)
    texts = {"en": "the cat and the dog of this house", "fr": "les chats et les chiens de cette maison"}
    learn = spark.createDataFrame([(i, f"{texts[x]} {i}", x) for i in range(200) for x in texts] + [(999, "les deux", None)], "doc_id long, text string, lang string")
    model = langid.train(learn)
    tried = spark.createDataFrame([(1, "the house of the dog"), (2, "la maison des chats et les chiens"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(tried, model, ["doc_id"]).orderBy("doc_id").collect()] == ["en", "fr", "und", "und", "und"]
    assert langid.train(learn.limit(0)) is None and {r["lang_pred"] for r in langid.identify(tried, None, ["doc_id"]).collect()} == {"und"}
    assert license_scan.scan_licenses(empty).count() == 0 and pii.pseudonymise_documents(empty, "k", ["doc_id"]).count() == 0


def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "x" * 120 + "</p>"
    rows = [(5, "http://a/5", same), (3, "http://a/3", same), (9, "http://b/9", same), (4, "u", "tiny"), (2, "u", "tiny"), (1, None, None), (None, "n", "é" * 200_000), (3, "http://a/3", same)]
    rows += [(100 + i, f"http://c/{i}", f"<p>{i}</p>" * 50) for i in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    base = f"file://{tmp_path}/w"
    manifest = warc.write(pages, base, roll_bytes=4096).collect()
    assert sum(r["records"] for r in manifest) == len(rows) and len({r["path"] for r in manifest}) == len(manifest) > 3
    assert all(hashlib.sha256((tmp_path / "w" / r["path"]).read_bytes()).hexdigest() == r["sha256"] for r in manifest) and not (tmp_path / "w" / "_temporary").exists()
    got = warc.read(spark, base).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((k or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for k, _, h in rows)
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in got if r["page_id"] in (3, 5, 9, 4, 2))
    assert kinds == [(2, "response", 0), (3, "response", 0), (3, "revisit", 3), (4, "response", 0), (5, "revisit", 3), (9, "revisit", 3)]
    again = f"file://{tmp_path}/v"
    assert sorted((r["path"], r["sha256"]) for r in warc.write(pages, again, roll_bytes=4096).collect()) == sorted((r["path"], r["sha256"]) for r in manifest)
    assert warc.read(spark, base) is not None
    warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Where is the report?\nI need it today."),
        (1, 1, "a", "Ann wrote:\n> Where is the report?\n> I need it today.\n\nOn your desk."),
        (1, 2, "u", "> On your desk.\n>> where is the REPORT\nThanks!"),
        (1, 3, "a", "> never said\nWhat?"),
        (1, 3, "a", "> never said\nWhat?"),
        (2, 0, "u", None),
        (2, None, "u", "> x"),
        (None, 1, "u", ""),
        (3, 1, "u", "> On your desk.\nother conversation"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("reply_level", F.lit("x"))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}
    assert got[1, 1]["text"] == "On your desk." and got[1, 1]["parent_turn"] == 0 and got[1, 1]["reply_level"] == 1
    assert (got[1, 2]["text"], got[1, 2]["parent_turn"], got[1, 2]["thread_turn"], got[1, 2]["reply_level"], got[1, 2]["quote_levels"], got[1, 2]["n_linked"]) == ("Thanks!", 1, 0, 2, 2, 2)
    assert got[1, 3]["parent_turn"] is None and got[1, 3]["text"] == "What?" and got[2, 0]["text"] is None and got[3, 1]["parent_turn"] is None
    assert quotes.link_quotes(df).count() == len(rows) and quotes.link_quotes(df.limit(0)).count() == 0


def _pair_recall(spark, n_pairs, common, **params):
    """The share of planted pairs that are in one class; a pair's texts have Jaccard 0.8 exactly, those of two pairs share a passage."""
    rows = []
    for k in range(n_pairs):
        passage = [f"c{i}" for i in range(9 * common)]
        a = passage + [f"p{k}w{i}" for i in range(49)]
        n = len(a) - 4
        b = a[: len(a) - n // 9] + [f"p{k}v{i}" for i in range(n // 9)]
        x, y = (set(jaccard_join.shingles(" ".join(t)).tolist()) for t in (a, b))
        assert n % 9 == 0 and len(x & y) / len(x | y) == 0.8
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    found = {r["doc_id"]: r["class_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **params).collect()}
    assert all(c // 2 == d // 2 for d, c in found.items())
    return sum(found[2 * k + 1] == 2 * k for k in range(n_pairs)) / n_pairs


def test_recall_of_isolated_pairs(spark):
    assert _pair_recall(spark, 2000, 0) >= 0.99


def test_recall_in_crowded_buckets(spark):
    # Texts of any two pairs share half of their shingles or more, so buckets are far over the size that is compared.
    assert _pair_recall(spark, 500, 15, bucket=32) >= 0.99
    assert _pair_recall(spark, 500, 15, bucket=32, crowded=300) >= 0.99


def _like_texts(m):
    words = [f"g{i}" for i in range(120)]
    return [(i, " ".join(words[: i % 120] + [f"x{i}"] + words[i % 120 + 1 :])) for i in range(m)]


def _written(spark, rows, monkeypatch, **params):
    """Rows and bytes of all tables written for the rows' classes, which must be one."""
    sizes = [0, 0]

    def measured(df, name, real=jaccard_join.materialize):
        out = real(df, name)
        folder = out._scratch.removeprefix("file://")
        sizes[0] += out.count()
        sizes[1] += sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part-"))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", measured)
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **params).collect()
    monkeypatch.undo()
    assert {r["class_id"] for r in found} == {0} and all(r["n_links"] > 0 for r in found)
    return np.array(sizes)


@pytest.mark.parametrize("params", [{}, {"bucket": 64, "crowded": 200}])
def test_dense_groups_grow_with_their_size(spark, monkeypatch, params):
    small, large = (_written(spark, _like_texts(m), monkeypatch, **params) for m in (600, 2400))
    assert (large <= 5 * small).all(), (small, large)


def test_all_links_of_dense_groups_count(spark):
    rows = _like_texts(60)
    rows = [(i, t) for i, t in rows] + [(1000 + i, t) for i, t in rows[:7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = brute(rows)
    assert max(t[2] for t in truth) > 20
    for params in ({}, {"bucket": 16, "crowded": 40, "block_words": 400}):
        got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs, recall=0.9999, **params).collect())
        assert got == truth


def test_like_sets_without_links_are_told_apart(spark):
    # All alike, none linked: every text shares 70 % with any other, and a few pairs are linked.
    rows = [(i, " ".join(f"h{j}" for j in range(70)) + " " + " ".join(f"y{i}z{j}" for j in range(16))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for params in ({}, {"bucket": 8, "crowded": 20}):
        got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs, recall=0.9999, **params).collect())
        assert got == brute(rows)


def test_runs_cover_the_deepest_level():
    runs = jaccard_join.split_runs(0.99, 0.8)
    lost = [(1 - jaccard_join.meeting_probability(0.8, d)) ** sum(runs[: i + 1]) for i, d in enumerate(jaccard_join.LEVELS)]
    assert sum(lost) <= 0.01


def test_hosts_of_symbols_or_repeated_lines_go(spark):
    rows = [(i, f"{i} " + BASE, f"good{i % 4}") for i in range(80)]
    rows += [(200 + i, " ".join(f"$#{i}x{j}" for j in range(30)), "symbols") for i in range(40)]
    rows += [(300 + i, "menu\nmenu\nmenu\n" + " ".join(f"{i}x{j}" for j in range(30)), "lines") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert not quality.judge(docs, ["doc_id"]).filter("base_failed").count()
    assert {r["doc_id"] for r in quality.kept_documents(docs).collect()} == set(range(80))


def test_each_passage_has_its_own_original(spark):
    rows = [(1, i, f"question number {i} stands here") for i in range(5)]
    rows += [(1, 5, "> question number 1 stands here\nyes\n> question number 4 stands here\nno\n> never said\nwhat"), (1, 5, "> question number 2 stands here\nyes")]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).filter("turn = 5").orderBy("n_passages").collect()
    assert [(r["n_passages"], r["n_linked"], r["parent_turn"], r["reply_level"]) for r in got] == [(1, 1, 4, 1), (3, 2, 4, 1)]
    links = quotes.quote_links(spark.createDataFrame(rows[:6], "conv_id long, turn long, text string"))
    assert sorted(r["original"] for r in links.collect()) == [1, 4]


def _linked(rows):
    """(conversation, turn) to (passages, linked passages, parent), by plain loops."""
    norm = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    units = lambda bodies: {*(u := [n for b in bodies if (n := norm(b))]), *([" ".join(u)] if len(u) > 1 else [])}

    def lines(text):
        for line in text.split("\n"):
            body = line.lstrip(" \t")
            depth = 0
            while body.startswith(">"):
                depth, body = depth + 1, body[1:].removeprefix(" ")
            yield depth, body

    first, passages = {}, {}
    for c, t, text in rows:
        own = []
        runs = passages[c, t] = []
        for depth, body in lines(text):
            if depth == 0:
                own.append(body)
                runs.append(None)
            elif runs and runs[-1] and runs[-1][0] == depth:
                runs[-1][1].append(body)
            else:
                runs.append((depth, [body]))
        for u in units(own):
            first[c, u] = min(t, first.get((c, u), t))
    out = {}
    for (c, t), runs in passages.items():
        runs = [r for r in runs if r]
        linked, level = 0, {}
        for depth, bodies in runs:
            votes = {}
            for u in units(bodies):
                if (o := first.get((c, u), t)) < t:
                    votes[o] = votes.get(o, 0) + len(u.split())
            if votes:
                w, o = max((w, o) for o, w in votes.items())
                linked += 1
                level[depth, o] = level.get((depth, o), 0) + w
        out[c, t] = len(runs), linked, max(((-d, w, o) for (d, o), w in level.items()), default=(0, 0, None))[2]
    return out


def test_quotes_against_loops(spark):
    rnd = random.Random(12)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta eta theta".split())
    rows = []
    for c in range(12):
        said = []
        for t in range(14):
            own = [" ".join(word() for _ in range(rnd.randrange(2, 6))) + rnd.choice(["", "!", " ?"]) for _ in range(rnd.randrange(1, 4))]
            parts = []
            for _ in range(rnd.randrange(0, 4) if said else 0):
                quoted = rnd.choice(said) if rnd.random() < 0.8 else ["never said " + word()]
                parts += [rnd.choice([">", "> ", ">> ", "> > "]) + x.upper() for x in quoted] + ["between " + word()] * rnd.randrange(2)
            rows.append((c, t, "\n".join(parts + own)))
            said.append(own)
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert {(r["conv_id"], r["turn"]): (r["n_passages"], r["n_linked"], r["parent_turn"]) for r in found} == _linked(rows)
    assert sum(r["n_linked"] for r in found) > 50


def test_pseudonyms_link_equal_values_and_nothing_else(spark):
    rnd = random.Random(3)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    cards = [next(x for i in range(10) if pii.luhn(x := b + str(i))) for b in ("4" + digits(14) for _ in range(20))]
    days = [f"20{rnd.randrange(10, 30)}-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}" for _ in range(20)]
    mails = [f"user{i}@host{i}.example.org" for i in range(20)]
    planted = cards + days + mails
    rows, where = [], []
    for i in range(200):
        own = [rnd.choice(planted) for _ in range(rnd.randrange(0, 4))]
        noise = [rnd.choice(["plain", "words", "v1.2", "12", "3.400", "page 7"]) for _ in range(10)]
        text = "".join(f"{n}; {v}, " for n, v in zip(noise, [*own, *[""] * 10], strict=False))
        rows.append((i, text))
        where.append(own)
    got = pii.pseudonymise_documents(spark.createDataFrame(rows, "doc_id long, text string"), "k", ["doc_id"]).orderBy("doc_id").collect()
    image = {}
    for (_, text), own, r in zip(rows, where, got, strict=True):
        assert [text[s["start"] : s["end"]] for s in r["spans"]] == own
        fields = [x.strip() for x in r["clean_text"].replace(";", ",").split(",")]
        for v, new in zip(own, fields[1::2], strict=False):
            assert image.setdefault(v, new) == new
    assert len(set(image.values())) == len(image)


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs.withColumn("score", F.lit("x")), langid.train(docs), ["doc_id", "lang"]).filter("lang IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 AND lang_pred <> 'und'").collect()
    assert len(found) > 100 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def test_decoding_against_a_plain_loop():
    rng = np.random.default_rng(4)
    langs = list("abcde")
    codes = langid.codewords(5)
    width = codes.shape[1]
    model = langid.Model(langs, codes, np.zeros((width, 1), np.float32), rng.random(width) + 0.5, rng.random(width) + 0.1)
    for _ in range(200):
        m = rng.normal(size=width)
        loss = [sum(model.trust[b] * np.log1p(np.exp(-2 * codes[i, b] * m[b] * model.scale[b])) for b in range(width)) for i in range(5)]
        assert model.decode(m)[0] == langs[int(np.argmin(loss))]
