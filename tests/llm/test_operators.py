"""Operators of the training-data subpackage against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from auditframe.llm import chat, decontamination, embedding_dedup, language_id, minhash, mixing, pii, queries, shingles, substring_dedup, token_files, toxicity
from auditframe.llm.scratch import Scratch, components
from tests.oracle import assert_same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang"), more.get("source", f"s{i % 3}"), None) for i, t in enumerate(texts)] if not isinstance(texts, dict) else [(i, t, None, "s", None) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(4)


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ro", "ta"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


EDGES = [None, "", " \n\t ", "one", "a b c d", "x " * 5000, "é ß 中 😀", "\\### Assistant: </turn>", "A a\nA a\nA a"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("run", [
    lambda d: decontamination.decontaminate(d, d.selectExpr("doc_id as item_id", "text")),
    lambda d: substring_dedup.dedup_units(d),
    lambda d: mixing.mix(d)[0],
    lambda d: mixing.mixed(d),
    lambda d: language_id.identify(d),
    lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as grade")),
    lambda d: minhash.near_duplicates(d),
    lambda d: minhash.without_near_duplicates(d),
    lambda d: pii.personal_data(d),
], ids=["decontaminate", "dedup_units", "mix", "mixed", "identify", "toxicity", "near_duplicates", "without_near_duplicates", "personal_data"])
def test_edges(spark, run):
    """Nulls everywhere, empty and long texts, repeated rows, clashing names, empty tables."""
    rows = [(i, t, None, None, None) for i, t in enumerate(EDGES)] + [(None, "null id here is a text of more words", "en", "s", 1), (3, "one", None, None, None), (3, "one", None, None, None)]
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as id", "'x' as hi", "2 as n", "3 as row", "'k' as key", "5 as bucket", "6 as component", "7 as version", "8 as tie")
    got = run(d).collect()
    if "doc_id" in run(d).columns and run.__code__.co_names[1] not in ("mixed", "without_near_duplicates"):
        assert len(got) == len(rows)
    assert run(d.limit(0)).collect() == []


def test_decontamination_reordered_and_brute(spark):
    rng = random.Random(4)
    items = {i: prose(rng, rng.randint(8, 40)) for i in range(12)} | {99: "too short", 98: None}
    texts = []
    for i in range(60):
        body = prose(rng, rng.randint(5, 60)).split()
        if i % 2:
            w = items[i % 12].split()
            cut = len(w) // 2
            body[1:1] = w if i % 3 else [*w[cut:], "zzz", *w[:cut]]
        texts.append(" ".join(body).upper() if i % 5 == 0 else " ".join(body))
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    d = docs(spark, texts)
    small = {r.doc_id: r for r in decontamination.decontaminate(d, b).collect()}
    large = {r.doc_id: r for r in decontamination.decontaminate(d, b, small=40).collect()}
    assert small == large

    def tiled(doc, item, k=5):
        """Greedy tiling by trying every pair of places."""
        used_d, used_i, total = set(), set(), 0
        while True:
            best = []
            for p, q in itertools.product(range(len(doc)), range(len(item))):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in used_d and q + n not in used_i:
                    n += 1
                if n >= k:
                    best.append((-n, p, q))
            if not best:
                return total / len(item)
            longest = min(best)[0]
            for n, p, q in sorted(x for x in best if x[0] == longest):
                if not used_d & set(range(p, p - n)) and not used_i & set(range(q, q - n)):
                    used_d |= set(range(p, p - n))
                    used_i |= set(range(q, q - n))
                    total -= n

    for i in range(0, 60, 3):
        doc = texts[i].lower().split()
        best = max(tiled(doc, items[j].lower().split()) for j in range(12))
        assert small[i].coverage == pytest.approx(best)
    assert all(small[i].contaminated for i in range(1, 60, 2) if i % 3)
    assert {r.doc_id for r in decontamination.without_leaks(d, b).collect()} == {i for i, r in small.items() if not r.contaminated} == {r.doc_id for r in decontamination.without_leaks(d, b, small=40).collect()}


def test_substring_spans(spark):
    long = " ".join(f"w{i}" for i in range(60))
    got = {r.doc_id: r for r in substring_dedup.dedup_units(docs(spark, [f"alpha\n{long}\nomega", f"{long.upper()}\nbeta", f"gamma\n{long}", "short line\nshort line"])).collect()}
    assert got[0].text == f"alpha\n{long}\nomega" and got[0].n_removed == 0
    assert got[1].text == "beta" and got[1].removed_spans == f"0:{len(long)}"
    assert got[2].text == "gamma" and (got[3].n_removed, got[3].text, got[3].removed_spans) == (1, "short line", "11:21")
    paragraphs = {r.doc_id: r.text for r in substring_dedup.dedup_units(docs(spark, [f"{long}\n\nx", f"y\n\n{long}"]), kind="paragraph").collect()}
    assert paragraphs == {0: f"{long}\n\nx", 1: "y"}


def test_mix_targets_by_resharing(spark):
    rng = random.Random(7)
    texts = {i: prose(rng, rng.randint(0, 30)) or None for i in range(300)}
    rows = [(i, t, None, [None, "a", "b", "b", "b", "b", "b", "c"][i % 8], None) for i, t in texts.items()]
    got = mixing.mix(spark.createDataFrame(rows, DOCS))[0].collect()
    size = {}
    for i, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(k for k in size if k) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full, left = {}, set(), float(sum(size.values()))
    while True:  # deal by weight, cap, deal again
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            full.add(s)
    target |= share
    taken = {}
    for r in got:
        s = rows[r.doc_id][3]
        assert r["size"] == len(WORD.findall(texts[r.doc_id] or "")) and r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert full and all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7))[0].collect()
    assert sorted(again) == sorted(got)
    whole = mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.text == texts[r.doc_id] for r in whole)


def test_language_held_out(spark, sf_dir):
    d = queries.table(spark, sf_dir, "documents")
    truth = {r.doc_id: r.lang for r in d.collect()}
    got = language_id.identify(d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9
    none = {r.doc_id: r.lang_pred for r in language_id.identify(d.withColumn("lang", d.lang.cast("string")).limit(50)).collect()}
    assert len(none) == 50
    assert {r.lang_pred for r in language_id.identify(docs(spark, ["12 34", None, ""], lang="en")).collect()} == {"und"}


def test_toxicity_separates_and_orders(spark):
    rng = random.Random(2)
    texts, grades = [], []
    for i in range(400):
        g = i % 3
        words = prose(rng, 40).split() + {0: [], 1: ["grumpish"], 2: ["grumpish", "vilenasty"]}[g]
        rng.shuffle(words)
        texts.append(" ".join(words))
        grades.append(g)
    model = toxicity.fit(texts[:300], grades[:300])
    z = toxicity._scored(model, toxicity.Hits(model.features), texts[300:])
    assert (model.grade(z) == np.array(grades[300:])).mean() > 0.95
    s = model.severity(z)
    assert s[np.array(grades[300:]) == 0].max() < s[np.array(grades[300:]) == 2].min()
    assert ((z >= model.cut) == (np.array(grades[300:]) > 0)).all()
    labels = spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int")
    kept = {r.doc_id for r in toxicity.without_toxic(docs(spark, texts), labels).collect()}
    assert kept == {i for i, g in enumerate(grades) if g == 0}


def families(rng):
    texts = {}
    for f in range(8):
        base = prose(rng, rng.choice([4, 6, 60, 200])).split()
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts[len(texts)] = " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()
    return texts


@pytest.mark.parametrize("percent,block", [(85, 256), (80, 3)])
def test_near_duplicates_brute(spark, monkeypatch, percent, block):
    """Also with blocks so small that every group is dealt over several."""
    monkeypatch.setattr(minhash, "BAND_BLOCK", block)
    monkeypatch.setattr(minhash, "SET_BLOCK", block)
    texts = families(random.Random(percent)) | {1000: "", 1001: None, 1002: "only", 1003: "only"}
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    group = {i: i for i in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, texts), percent=percent).collect()}
    assert got == {i: (len(sets[i]), group[i], group[i] == i) for i in texts}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.id: r.component for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}


def test_shingles_are_whole():
    seen = shingles.WordHashes()
    assert len(shingles.shingle_set("a b c d e f", seen)) == 2 and len(shingles.shingle_set("A b", seen)) == 1
    assert (shingles.shingle_set("A B C D E", seen) == shingles.shingle_set("a b c d e", seen)).all()
    assert len(shingles.shingle_set("É b", seen)) and (shingles.shingle_set("É b", seen) != shingles.shingle_set("é b", seen)).all()


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_encoder_equals_library():
    path, t = tokenizer()
    e, rng = token_files.Encoder(path), random.Random(3)
    alphabet = list("ab'sT 1\n\t\x1c\x1f\x85 ​ 　é²½中٣_-😀\x0b\x0c\r\x00ǅ") + ["<|endoftext|>", "'ll", "  "]
    for n in range(3000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        x = x.encode("ascii", "ignore").decode() if n % 3 == 0 else x
        assert e.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes(), repr(x)


def test_latin_texts_split_as_all_do(monkeypatch):
    path, t = tokenizer()
    rng = random.Random(4)
    alphabet = [chr(c) for c in [*range(128), *token_files.LATIN]] + list("ab'sT 1\n\t\x85\xa0éß²½") * 20
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(20_000)]
    for x in texts:
        assert token_files.LATIN_SPLIT.findall(x) == token_files.SPLIT.findall(x), repr(x)
    assert all(token_files.BEYOND_LATIN.search(f"é{x}") for x in "\u0250\u0301\u1680\u2000\u2028\u202f\u205f\u3000中😀") and not token_files.BEYOND_LATIN.search("Größe – “à” €")
    monkeypatch.setattr(token_files, "SPLIT", None)  # Latin texts don't need it
    e = token_files.Encoder(path)
    for x in [*texts[:2000], "Größe – “à” €"]:
        assert e.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes(), repr(x)


def test_token_files_round_trip(spark):
    path, t = tokenizer()
    rng = random.Random(5)
    texts = {i * 3: prose(rng, rng.randint(0, 900)) for i in range(200)} | {1: None, 2: "", 4: "<|endoftext|> é中"}
    manifest = token_files.write(docs(spark, texts), path, length=64)
    got = sorted(token_files.read_digests(spark, manifest).collect())
    at, want, stream = 0, [], []
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        stream += ids
    assert [tuple(r) for r in got] == want
    back = []
    for r in manifest.orderBy("shard").collect():
        f = token_files.TokenFile(r.path)
        for i in range(-(-r.n_ids // 64)):
            ids, mask = f.sequence(i)
            assert len(ids) == 64 and not ids.flags.owndata and not mask.flags.owndata and mask.dtype == bool
            back += ids[mask].tolist()
    assert back == stream
    assert token_files.read_digests(spark, token_files.write(docs(spark, {}), path)).collect() == []
    odd = spark.createDataFrame([(None, "b", 1), (3, None, 2), (3, "x y", 3), (3, "x y", 4), (None, None, 5)], "doc_id long, text string, shard int").selectExpr("*", "1 as start", "2 as tie")
    rows = token_files.read_digests(spark, token_files.write(odd, path)).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.n_tokens) for r in rows) == [(False, None, 1), (False, None, 2), (True, 3, 1), (True, 3, 3), (True, 3, 3)]
    assert sorted(r.start for r in rows) == [0, *itertools.accumulate(r.n_tokens for r in sorted(rows, key=lambda r: r.start))][:5] and [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, None, 3, 3, 3]


def test_special_strings_as_the_library(spark):
    path, t = tokenizer()
    e = token_files.Encoder(path)
    assert e.own
    for x in (f"a {e.own[0]} b", e.own[0], f"é{e.own[0]}{e.own[0]}\n", e.own[0][:-1]):
        assert e.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes(), x


def test_chat_round_trip():
    rng = random.Random(1)
    bits = ["\\", "#", "###", "</turn>", " </turn>\n", "### Assistant: ", "x", "\n", "<", "\\\\", "😀"]
    for _ in range(3000):
        messages = [(rng.choice(["user", "assistant", "System", "a:b", "%41", "", "tool\n", "ÉX", "ßx"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        formatted, spans = chat.render(messages)
        assert chat.parse(formatted) == messages
        assert [chat.unescape(formatted[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True)] == [t for r, t in messages if r == "assistant"]


def test_chat_events(spark):
    e = [(1, 0, 0, "start", "user", "hi"), (1, 1, 1, "start", "assistant", ""), (1, 2, 1, "delta", None, "he"), (1, 3, 1, "delta", None, "llo"), (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "hey"),
         (1, 6, 2, "start", "user", "more"), (1, 7, 0, "edit", None, "hi there"), (1, 8, 1, "start", "assistant", "yes"), (2, 0, 0, "start", "user", None), (None, 0, None, None, None, "x")]
    got = {r.conv_id: (r.n_turns, chat.parse(r.formatted)) for r in chat.format_events(spark.createDataFrame(e, "conv_id long, seq long, turn long, kind string, role string, text string")).collect()}
    assert got == {1: (2, [("user", "hi there"), ("assistant", "yes")]), 2: (1, [("user", "")]), None: (1, [("", "x")])}
    assert chat.format_events(spark.createDataFrame([], "conv_id long, seq long, turn long, kind string, role string, text string")).collect() == []


def test_fold_without_turns():
    start, delta, again = (0, "start", "user", "old"), (None, "delta", None, "new"), (None, "regenerate", None, None)
    assert chat.fold([start, (1, "start", "assistant", "old"), again, delta]) == [("user", "old"), ("assistant", "new")]
    assert chat.fold([(1, "start", "assistant", "old"), (2, "start", "user", "q"), again, delta, delta]) == [("assistant", "newnew"), ("user", "q")]
    assert chat.fold([start, (0, "regenerate", None, None), delta]) == [("user", "old"), ("assistant", "new")]
    assert chat.fold([start, (None, "edit", None, "x"), delta, (-1, "delta", "tool", "y"), delta]) == [("user", "xnew"), ("tool", "ynew")]
    assert chat.fold([again, delta]) == [("assistant", "new")] and chat.fold([(None, None, None, None)]) == [("", "")] and chat.fold([]) == []


def test_log_folds_into_its_rows(spark):
    """Deltas, edits and regenerations of the log, a long conversation, ties and nulls."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "é😀 </turn>", "### x", prose(rng, 9)])) for c in (1, 2, None) for t in range(6)]
    rows += [(9, t, "assistant" if t % 2 else "user", f"line {t}") for t in range(3000)] + [(8, None, "user", "a"), (8, 0, "user", "b"), (8, 0, "user", "b"), (8, 0, "assistant", "c")]
    log = chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "2 as step", "3 as kind"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_events(log).collect()}
    first = lambda v: (v is not None, v or "")
    for c in (1, 2, None, 9, 8):
        want = sorted((r for r in rows if r[0] == c), key=lambda r: ((r[1] is not None, r[1] or 0), first(r[2]), first(r[3] or "")))
        assert got[c] == [(r or "", t or "") for _, _, r, t in want], c
    assert chat.as_events(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_chat_query(spark, sf_dir):
    got = {r.conv_id: r for r in queries.QUERIES["op8_chat"](spark, sf_dir).collect()}
    rows = queries.table(spark, sf_dir, "conversations").collect() + [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r, x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_embeddings_brute(spark):
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 7)):
                rows.append((n, (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.15])).astype("f4").tolist(), label))
                n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0, None], 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [1.0, 0.0], 1), (n + 5, [], 1), (None, rows[0][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as n")
    links, ok = {i: set() for i, _, _ in rows}, [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for (a, x, la), (b, y, lb) in itertools.combinations(ok, 2):
        if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
            links[a].add(b)
            links[b].add(a)
    group = {i: i for i in links}
    for _ in links:
        for a in links:
            for b in links[a]:
                group[a] = group[b] = min(group[a], group[b])
    for block in (1024, 2):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_embeddings(frame, block=block).collect()}
        assert got == {i: (len(links[i]), group[i], group[i] == i) for i in links}
    assert embedding_dedup.near_embeddings(frame.limit(0)).collect() == []


def test_embedding_odd_numbers(spark):
    """Huge and tiny components, any number of lengths, and rows that repeat a vec_id."""
    one = [1.0 + i / 7 for i in range(8)]
    rows = [(0, [x * 1e300 for x in one], 1), (1, [x * 1e-300 for x in one], 1), (2, one, 1), (2, one, 1), (3, [5e-324] * 8, 1), (4, [float("inf")] * 8, 1), (5, one, 2)]
    rows += [(100 + i, [1.0] * (i // 2 + 1), 3) for i in range(2200)]
    got = {}
    for r in embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect():
        got.setdefault(r.vec_id, (r.n_links, r.component_id, r.kept))
    assert got[0] == (4, 0, True) and got[1] == (4, 0, False) and got[2] == (4, 0, False) and got[3] == (4, 0, False) or got[3][1] in (0, 3)
    assert got[4] == (0, 4, True) and got[5] == (0, 5, True)
    assert all(got[100 + i] == (1, 100 + i - i % 2, i % 2 == 0) for i in range(2200))


def test_embedding_grids():
    """Places of cells are those of the traversal, and the grid grows with the largest label."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 32))
    x = base[rng.integers(0, 300, 4000)] + rng.normal(size=(4000, 32)) * 0.1
    index = embedding_dedup.fit(x, 0.93, words=12)
    assert index.visits < 0.5 * 12**2
    u = embedding_dedup.unit(x[:50])
    d = embedding_dedup.squares(u[:, :16], index.first)[:, :, None] + embedding_dedup.squares(u[:, 16:], index.second)[:, None, :]
    order = d.reshape(50, -1).argsort(1, kind="stable")
    cells = index.cells(u, 144)
    assert (np.take_along_axis(d.reshape(50, -1), cells[:, : index.visits], 1) == np.take_along_axis(d.reshape(50, -1), order[:, : index.visits], 1)).all()
    assert (index.rank(u, cells[:, 7]) == 8).all()
    sizes = [len(embedding_dedup.best_index(x, 0.93, n).first) for n in (500, 50_000, 5_000_000)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]


@pytest.mark.parametrize("rank", [4, 48])
def test_embedding_recall(spark, rank):
    """Recall over 0.9 of pairs at and above the threshold, also where vectors lie in few directions."""
    rng = np.random.default_rng(rank)
    plane = rng.normal(size=(rank, 48))
    base = rng.normal(size=(900, rank))
    near = base[:400] + rng.normal(size=(400, rank)) * 0.36 * np.linalg.norm(base[:400], axis=1, keepdims=True) / rank**0.5
    x = np.concatenate([base, near]) @ plane
    u = embedding_dedup.unit(x.astype("f4").astype(float))
    true = (u @ u.T >= 0.93).sum(1) - 1
    frame = spark.createDataFrame([(i, v.astype("f4").tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    for words in (None, 24):
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_embeddings(frame, words=words).collect()}
        assert true.sum() > 100 and sum(got.values()) >= 0.9 * true.sum() and all(got[i] <= true[i] for i in got)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        total = sum((2 * int(c) - (9 if int(c) > 4 else 0)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]

    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if ok(k, m[0]))


def test_pii_base_spans(spark):
    rng = random.Random(2)
    bits = ["a", "b.c", "@", ".", "1", "23", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "+", "+1 (555) 123-4567", "(", "é", "😀", "\n", "a@b.co", "_d@e.f", "1.2.3.4", "00001.2.3.4", "7", "x@y", "[at]"]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for i in range(1500)}
    texts |= {5000: None, 5001: "1" * 100_000, 5002: "a" * 100_000, 5003: "a." * 50_000 + "@b.c", 5004: "x@" + "a." * 20_000 + "b", 5005: "+1" + " " * 50_000, 5006: " ".join(["+49 170 1234567"] * 2000)}
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        spans = base_spans(t)
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), repr(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[3] == k for s in spans) for k in pii.KINDS]
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))


def test_pii_trees_learn_and_calibrate():
    rng = random.Random(3)
    counts, digits, plus = [], pii.FEATURES.index("f_digits"), pii.FEATURES.index("f_plus")
    for _ in range(400):
        x = tuple(rng.randint(0, 15) if i == digits else rng.randint(0, 1) for i in range(len(pii.FEATURES)))
        good = x[digits] >= 10 and x[plus] == 1
        counts.append(("phone", x, 5 * good, 5, 5 * good, 5))
    model = pii.fit(counts)
    least = model.thresholds["phone"]
    assert all((model.of(x) >= least) == bool(p) for _, x, p, *_ in counts)


def test_pii_finds_hidden_spans(spark):
    """Spans written as people hide them are added beside the base, numbers of other kinds are left alone, and nothing overlaps."""
    rng = random.Random(9)

    def card():
        while True:
            d = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if sum((2 * int(c) - (9 if int(c) > 4 else 0)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0:
                return d

    name = lambda: prose(rng, 1).replace(" ", "")
    plain = [lambda: f"mail me at {name()}.{name()}@{name()}.com", lambda: f"call +{rng.randint(1, 9)} {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}", lambda: f"host {'.'.join(str(rng.randint(0, 255)) for _ in range(4))}", lambda: f"card {card()}"]
    hidden = {
        "email": lambda: f"{name()} [at] {name()} [dot] com", "ip": lambda: "[.]".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": lambda: " - ".join(re.findall("....", card())),
    }
    other = [lambda: f"in {rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 99)}.{rng.randint(0, 9)} percent", lambda: f"pages {rng.randint(1, 400)}-{rng.randint(400, 900)}", lambda: f"at {rng.randint(0, 23)}:{rng.randint(10, 59)} [ok]"]
    texts, planted = {}, {}
    for i in range(900):
        parts = [prose(rng, 8), rng.choice(plain)(), prose(rng, 5), rng.choice(other)(), prose(rng, 6), rng.choice(other)()]
        texts[i] = ", ".join(parts)
        if i % 15 == 0:
            kind = list(hidden)[i // 15 % 3]
            span = hidden[kind]()
            start = len(texts[i]) + len(" then: ")
            texts[i] += f" then: {span} and so on"
            planted[i] = f"{kind}:{start}:{start + len(span)}"
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    added = {i: set(r.spans.split(",")) - {f"{k}:{a}:{e}" for a, _, e, k in base_spans(texts[i])} - {""} for i, r in got.items()}
    assert all(len(added[i]) == got[i].n_added for i in texts)
    right = sum(planted[i] in added[i] for i in planted)
    assert right >= 0.9 * len(planted) and sum(map(len, added.values())) <= right / 0.9
    for r in got.values():
        places = sorted(tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s)
        news = sorted(tuple(map(int, s.split(":")[1:])) for s in added[r.doc_id])
        assert all(a[1] <= b[0] or b[1] <= a[0] for a in news for b in places if a != b)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    d, names = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    scratch = Scratch(spark, "test-pipeline")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.save(stage(spark, d, sf_dir), name)
        assert out.columns == d.columns
        kept.append((name, {r.doc_id for r in d.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}))
        d = out
        names.append(name)
    assert all(after <= before for _, before, after in kept) and len(kept[1][2]) < len(kept[1][1]) and len(kept[2][2]) < len(kept[2][1])
    final = corpus_pipeline.STAGES[-1][1](spark, d, sf_dir)
    assert final.count() == d.count()


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and empty tables, through all stages."""
    import corpus_pipeline

    rng = random.Random(31)
    rows = [(i, t, None, None, None) for i, t in enumerate(EDGES)] + [(None, None, None, None, None), (None, prose(rng, 30), "en", "s", 1), (3, "one", None, None, None), (3, "one", None, None, None)]
    rows += [(100 + i, prose(rng, 40) + (" grumpish vile" if i % 4 == 0 else ""), "en", "s", None) for i in range(80)]
    labels = [(100 + i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(80)] + [(None, 1, 1), (0, None, None)]
    for name, some in (("full", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, DOCS).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, rows[-1][1]), (2, None), (None, "x y z a b c")] if some else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert bool(got) == bool(some)
        if some:
            ids = [r.doc_id for r in got]
            assert not {100 + i for i in range(0, 80, 4)} & set(ids) and 179 not in ids and None in ids and {100 + i for i in range(80) if i % 4 and i < 79} - set(ids) == set()
            assert sorted(r.start for r in got) == [0, *itertools.accumulate(r.n_tokens for r in sorted(got, key=lambda r: r.start))][: len(got)]


def test_passages_inside_lines(spark):
    rng = random.Random(12)
    passage = " ".join(f"{prose(rng, rng.choice([2, 9, 12])).capitalize()}." for _ in range(8))
    texts = [f"{prose(rng, 6)} here it comes: {passage} {prose(rng, 7)}", f"{prose(rng, 9)}.  {passage.upper()}\n{prose(rng, 8)}.", f"{prose(rng, 11)}. {prose(rng, 6)}!"]
    got = {r.doc_id: r for r in substring_dedup.dedup_units(docs(spark, texts), kind="passage").collect()}
    assert got[0].text == texts[0] and got[2].text == texts[2]
    gone = "".join(texts[1][int(a):int(b)] for a, b in (s.split(":") for s in got[1].removed_spans.split(",")))
    assert len(gone) > 0.7 * len(passage) and gone.isupper() and got[1].text.startswith(texts[1].split(".")[0])


def brute_passages(texts, min_words=5):
    """Units, and those of them in a run of ``min_words`` words or a whole line that occurs earlier, by trying every run."""
    units, seen, gone = {}, {}, {}
    for d, t in texts.items():
        spans = substring_dedup.split_units(t, "passage")
        units[d] = [(n, a, b, u) for n, (a, b) in enumerate(spans) if (u := substring_dedup.normal(t[a:b]))]
        for i in range(len(units[d])):
            for j in range(i, len(units[d])):
                first, last = units[d][i], units[d][j]
                said = " ".join(x[3] for x in units[d][i : j + 1])
                inside = t[first[1] : last[2]]
                whole = "\n" not in inside and not t[: first[1]].rpartition("\n")[2].strip() and not t[last[2] :].partition("\n")[0].strip()
                if substring_dedup.words(said) >= min_words or whole:
                    seen.setdefault((whole and substring_dedup.words(said) < min_words, said), []).append((d, i, j))
    for at in seen.values():
        for d, i, j in at[1:]:
            gone.setdefault(d, set()).update(x[0] for x in units[d][i : j + 1])
    return {d: (sorted(gone.get(d, ()))) for d in texts}


def test_short_units_are_compared(spark):
    """Short lines, passages of short sentences and scripts without blanks, against every run."""
    rng = random.Random(21)
    few = [f"{prose(rng, n)}." for n in (1, 1, 2, 3, 4, 5, 6)]
    short = " ".join(f"{prose(rng, rng.randint(1, 4))}." for _ in range(20))
    texts = [f"{prose(rng, 7)}. {short} {prose(rng, 8)}.", f"{prose(rng, 9)}. {short}\n{prose(rng, 6)}.", f"{prose(rng, 7)}.\nall rights reserved.\nx", f"{prose(rng, 8)}.\nAll  rights reserved.", "日本語の文章です\n次", "違う\n日本語の文章です"]
    texts = dict(enumerate(texts + ["".join(rng.choice(few) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randint(1, 7))) for _ in range(60)]))
    got = {r.doc_id: r for r in substring_dedup.dedup_units(docs(spark, texts), kind="passage").collect()}
    assert short not in got[1].text and got[1].n_removed == 20 and "rights" not in got[3].text and got[5].text == "違う"
    want = brute_passages(texts)
    for d, t in texts.items():
        spans = substring_dedup.split_units(t, "passage")
        said = {tuple(map(int, s.split(":"))) for s in got[d].removed_spans.split(",") if s}
        assert {s for s in said if substring_dedup.normal(t[slice(*s)])} == {spans[n] for n in want[d]}, (d, t)


@pytest.mark.parametrize("end", ['." ', ".) ", "!” ", "… ", "؟ ", "। ", "。", "。」", "！"])
def test_sentence_marks(spark, end):
    """Passages whose sentences end otherwise, inside lines between other words; all but the edges that run into them goes."""
    rng = random.Random(13)
    passage = "".join(prose(rng, 9) + end for _ in range(8))
    texts = [f"{prose(rng, 6)}{end}{passage}{prose(rng, 7)}", f"{prose(rng, 9)}{end}{passage}{prose(rng, 8)}"]
    got = {r.doc_id: r for r in substring_dedup.dedup_units(docs(spark, texts), kind="passage").collect()}
    assert got[0].text == texts[0] and got[1].text == texts[1].replace(passage, "") and got[1].n_removed == 8


def test_sentences_are_whole():
    text = 'He said "go." Then (so he did!) v1.2 at 3.5。「はい。」「次」\r\nlast？　x y'
    spans = substring_dedup.split_units(text, "passage")
    assert [text[a:b] for a, b in spans] == ['He said "go."', "Then (so he did!)", "v1.2 at 3.5。", "「はい。」", "「次」", "last？", "x", "y"]


def test_passages_without_stops_stay(spark):
    """What unit hashing can't reach, as the README says: a passage without sentence marks between other words."""
    rng = random.Random(14)
    passage = ", ".join(prose(rng, 10) for _ in range(6))
    texts = [f"{prose(rng, 6)} {passage} {prose(rng, 7)}.", f"{prose(rng, 9)} {passage} {prose(rng, 8)}.", f"{prose(rng, 9)}.\n{passage}\n{prose(rng, 8)}.", f"{prose(rng, 5)}.\n{passage}\n{prose(rng, 8)}."]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_units(docs(spark, texts), kind="passage").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1}


def test_toxicity_reads_long_runs(spark):
    """A term after 200 and after 5,000 letters of an unbroken run counts, in fitting and in scoring."""
    rng = random.Random(15)
    runs = ["".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(n)) for n in [300, 1200, 6000] * 20]
    texts = [r + ("毒毒坏坏恶恶" if i % 2 else "") + r[:40] for i, r in enumerate(runs)]
    model = toxicity.fit(texts, [i % 2 for i in range(len(texts))])
    assert "毒毒坏坏恶恶" in model.features
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, grade int")
    assert {r.doc_id for r in toxicity.without_toxic(docs(spark, texts), labels).collect()} == set(range(0, len(texts), 2))


def test_many_languages(spark):
    """300 languages of a word of their own are all learnt; more than the bound are an error."""
    d = spark.createDataFrame([(i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 3]} " * 9, f"l{i % 300:03d}", "s", None) for i in range(3000)], DOCS)
    got = language_id.identify(d).collect()
    assert len({r.lang_pred for r in got}) == 300 and sum(r.lang_pred == f"l{r.doc_id % 300:03d}" for r in got) > 0.95 * len(got)
    with pytest.raises(ValueError, match="more than 2 "):
        language_id.identify(d, languages=2)
    assert set(language_id.learn(d.where("lang < 'l003'"), languages=3).languages) == {"l000", "l001", "l002"}


def test_language_of_no_letters_and_long_texts(spark):
    """Numbers, marks and symbols are no letters; a text of 400,000 words scores as a short one of its language."""
    rng = random.Random(17)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(4000)] for lang, letters in (("xx", "abcdefghij"), ("yy", "efghijklmn"))}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, say("xy"[i % 2] * 2, 40), "xy"[i % 2] * 2, "s", None) for i in range(300)]
    rows += [(1000, "½ ² ① 12 Ⅷ", None, "s", None), (1001, "\u0301\u093f", None, "s", None), (1002, say("xx", 400_000), None, "s", None), (1003, say("yy", 400_000), None, "s", None), (1004, "ª", None, "s", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1000] == got[1001] == ("und", 0.0) and got[1002][0] == "xx" and got[1003][0] == "yy" and got[1004][0] != "und"


def test_language_kernel_is_exact(spark):
    """Regression on all texts as landmarks is kernel ridge regression with the kernel counted by hand, on classes of one size."""
    rng = random.Random(18)
    texts, langs = [prose(rng, 30) + (" zz" * 5 if i % 2 else " qq" * 5) for i in range(40)], ["ab"[i % 2] for i in range(40)]
    model = language_id.fit(texts, langs, landmarks=20)
    bins = []
    for t in texts:
        out = np.zeros(language_id.BINS, np.float32)
        language_id.presence(f" {t} ", out)
        bins.append(set(np.flatnonzero(out)))
    k = np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in bins] for x in bins])
    assert np.allclose(k, language_id.spectra(texts) @ language_id.spectra(texts).T, atol=1e-5)
    y = np.where(np.array(langs)[:, None] == np.array(["a", "b"])[None, :], 1.0, -1.0)
    want = k @ np.linalg.solve(k + language_id.RIDGE * len(y) / 2 * np.eye(len(y)), y)
    got = language_id.spectra(texts) @ model.landmarks.T @ model.whiten @ model.coefficients
    assert np.allclose(got, want, atol=0.02) and (got.argmax(1) == want.argmax(1)).all()


def test_tiles_of_repeated_words():
    """8,000 equal words against as many, and random ones of few words against trying every pair."""
    import time
    import tracemalloc

    tracemalloc.start()
    t = time.time()
    assert decontamination.tile(np.ones(8000, np.int64), np.ones(8000, np.int64)) == [(0, 0, 8000)]
    assert decontamination.tile(np.ones(8000, np.int64), np.ones(3000, np.int64)) == [(0, 0, 3000)]
    assert time.time() - t < 2 and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    item = "x " * 3000
    assert decontamination.Benchmark([(1, item)]).leaks("y " + "x " * 8000) == [(1, 1.0)]
    assert decontamination.tokens("Ünï—naïve 日本、です a_b") == [x.encode() for x in ["Ünï", "naïve", "日", "本", "で", "す", "a", "b"]]


def test_clashing_names(spark):
    """Filters return the columns they got, whatever they are called, and drop what the operator says."""
    rng = random.Random(23)
    texts = [prose(rng, 30) + (" grumpish vile" if i % 3 == 0 else "") for i in range(90)]
    d = docs(spark, texts).selectExpr("*", "1 as grade", "2 as severity", "3 as row", "4 as item_id", "5 as coverage", "6 as __hit_", "7 as component_id", "8 as kept", "9 as n", "10 as __id")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, grade int")
    bench = spark.createDataFrame([(1, texts[1]), (2, texts[2])], "item_id long, text string")
    clean = toxicity.without_toxic(d, labels)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i in range(90) if i % 3}
    for small in (1000, 20):
        left = decontamination.without_leaks(d, bench, small=small)
        assert left.columns == d.columns and {r.doc_id for r in left.collect()} == set(range(90)) - {1, 2}
    twice = d.unionByName(d.selectExpr("doc_id + 1000 as doc_id", *d.columns[1:]))
    kept = minhash.without_near_duplicates(twice)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(range(90))
    assert toxicity.without_toxic(d, labels.limit(0)).count() == 90 and toxicity.without_toxic(d, labels.where("grade = 1")).count() == 90
