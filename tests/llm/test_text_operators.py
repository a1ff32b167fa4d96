from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from boardsift.llm import bpe, chat_format, decontaminate, jaccard, language, quality, suffixes, token_files, tokens
from tests.llm.helpers import clashing, documents

LONG = " ".join(f"word{i}" for i in range(5000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a b"), (6, "Über 中文 ½ Σς <|endoftext|>x İ"), (7, "same " * 100), (8, "same " * 100), (8, "same " * 100), (9, LONG), (10, LONG + " end"), (None, "no id"), (None, None)]


def oracle(sql, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v)
    return con.execute(sql).fetchall()


# ---- 1


ITEMS = [(1, "one two three"), (2, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (3, None), (4, "..."), (10, "Two THREE"), (None, "zz yy")]
TEXTS = [(1, "x One, two; three! y two three"), (2, "b c d e f g h i j k"), (3, "b c d e f g h i j"), (4, None), (5, ""), (6, "zz yy zz yy"), (6, "zz yy zz yy"), (7, LONG + " one two three"), (None, "one two three")]


def brute_hits(texts, items):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for i, t in texts:
        w, hit, names = cut(t), set(), set()
        for name, item in items:
            v = cut(item)
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        names.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_decontamination_against_brute_force(spark, limit):
    docs, items = clashing(documents(spark, TEXTS)), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.decontaminate(docs, items, broadcast_windows=limit).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=str) == brute_hits(TEXTS, ITEMS)


def test_decontamination_of_nothing(spark):
    docs, items = documents(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert [r.n_hit for r in decontaminate.decontaminate(documents(spark, TEXTS[:1]), items.limit(0)).collect()] == [0]


# ---- 2


def brute_cut(texts):
    raw = [(t or "").encode() for t in texts]
    seen: dict = {}
    for x in raw:
        for i in range(len(x) - 199):
            seen[x[i : i + 200]] = seen.get(x[i : i + 200], 0) + 1
    out = []
    for x in raw:
        hit = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                hit[i : i + 200] = True
        out.append((len(x), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), bytes(np.frombuffer(x, np.uint8)[~hit])))
    return out


def passages():
    random.seed(7)
    words = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(random.choice(words) for _ in range(n))

    shared, line = prose(60), "All rights reserved by nobody in particular. "
    rows = [prose(80), prose(40) + shared + prose(30), shared + prose(50), prose(20) + shared, line * 20, prose(5) + line * 9, "x" * 650, "x" * 199, "y" * 200, None, "", prose(100)]
    rows += [rows[0], rows[-1][:400] + "!" + rows[-1][401:], rows[-1]]
    return rows


def test_repeats_against_brute_force(spark):
    rows = passages()
    got = suffixes.without_repeats(clashing(documents(spark, list(enumerate(rows))))).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_spans, bytes(r.kept)) for r in got) == [(i, *x) for i, x in enumerate(brute_cut(rows))]


@pytest.mark.parametrize(("hot", "held", "frequent"), [(1, 500_000, 10_000), (2000, 3, 10_000), (2000, 500_000, 2), (3, 500_000, 2)])
def test_crowded_anchors_against_brute_force(spark, monkeypatch, hot, held, frequent):
    """Many different fragments of one anchor: strings told apart by content, anchors that a task doesn't hold whole, anchors dealt by content."""
    for name, value in (("HOT", hot), ("HELD", held), ("FREQUENT", frequent)):
        monkeypatch.setattr(suffixes, name, value)
    random.seed(17)
    shared = "".join(random.choice("abcdefgh ") for _ in range(420))
    rows = passages() + ["".join(random.choice("abcdefgh ") for _ in range(150)) + shared[: random.randint(250, 420)] + "".join(random.choice("abcdefgh ") for _ in range(150)) for _ in range(30)]
    got = suffixes.without_repeats(documents(spark, list(enumerate(rows))).repartition(5)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_spans, bytes(r.kept)) for r in got) == [(i, *x) for i, x in enumerate(brute_cut(rows))]


def test_only_the_merge_finds_repeats(spark, monkeypatch):
    """With a merge that finds nothing, nothing but equal texts goes."""
    rows = passages()
    docs = documents(spark, list(enumerate(rows)))
    assert sum(r.n_spans for r in suffixes.without_repeats(docs).collect()) > 10
    monkeypatch.setattr(suffixes, "repeated", lambda strings, weights, owners=None: [np.zeros(len(x), bool) for x in strings])
    got = {r.doc_id: r for r in suffixes.without_repeats(docs).collect()}
    equal = {i for i, t in enumerate(rows) if t and len(t.encode()) >= 200 and rows.count(t) > 1}
    assert equal and {i for i, r in got.items() if r.n_spans} == equal


def test_interleave_of_several_shards_is_sorted():
    random.seed(2)
    strings = ["".join(random.choice("ab") for _ in range(random.randint(0, 400))).encode() for _ in range(30)]
    shards = [suffixes.Shard(strings[k::4]) for k in range(4)]
    at, block = suffixes.merged(shards, np.full(sum(map(len, strings)) + len(strings), 2.0), 16)
    texts = [s for k in range(4) for s in strings[k::4]]
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])
    whole = b"\0".join([*texts, b""])
    place = np.concatenate([x.order + b for x, b in zip(shards, np.cumsum([0, *(len(x.order) for x in shards)]), strict=False)])
    prefixes = [whole[p : p + 16] for p in place[at].tolist()]
    assert prefixes == sorted(whole[p : p + 16] for t, b in zip(texts, base.tolist(), strict=False) for p in range(b, b + len(t) - 15))
    assert block.tolist() == [sorted(set(prefixes)).index(x) for x in prefixes]


def test_repeats_of_odd_rows(spark):
    got = suffixes.without_repeats(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert sorted((r.n_bytes, r.n_spans, bytes(r.kept)) for r in got) == sorted(brute_cut([t for _, t in ODD]))
    assert suffixes.without_repeats(documents(spark, [])).count() == 0


def test_merged_transforms_find_repeated_intervals():
    random.seed(1)
    for _ in range(20):
        base = bytes(random.choice(b"ab\x00c") for _ in range(600))
        strings = list({base[random.randint(0, 200) : random.randint(420, 600)] for _ in range(random.randint(1, 6))})
        weights = np.array([random.choice([1.0, 2.0]) for _ in strings])
        seen: dict = {}
        for s, w in zip(strings, weights, strict=True):
            for i in range(len(s) - 199):
                seen[s[i : i + 200]] = seen.get(s[i : i + 200], 0) + w
        for s, hit in zip(strings, suffixes.repeated(strings, weights), strict=True):
            assert hit.tolist() == [i + 200 <= len(s) and seen[s[i : i + 200]] >= 2 for i in range(len(s))]


# ---- 3


def test_language(spark):
    random.seed(2)
    stems = {"aa": ["lo", "ra", "mi"], "bb": ["schu", "tzen", "gra"]}
    rows = [(i, " ".join("".join(random.choice(stems[y]) for _ in range(3)) for _ in range(30)), y) for i in range(120) for y in [("aa", "bb")[i % 2]]]
    model = language.learn(documents(spark, [*rows, (1000, None, "aa"), (1001, "x", None)]))
    got = {r.doc_id: r for r in language.identify(clashing(documents(spark, [*rows, (500, None), (501, "12 !?"), (502, ""), (503, " ".join([rows[0][1]] * 400), "bb")])), model).collect()}
    assert np.mean([got[i].lang_pred == y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.95
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0
    assert got[503].lang_pred == "aa" and 0 <= got[503].score <= 1
    p = model.label_words([language.words_of(rows[0][1] + " " + rows[1][1])])
    assert p[:30].argmax(1).tolist().count(0) > 25 and p[30:].argmax(1).tolist().count(1) > 25


def test_predictions_against_brute_force(spark):
    """Features by their definition, and forward-backward word by word in log space."""
    random.seed(12)
    rows = [(i, " ".join("".join(random.choice(["lo", "ra", "mi"] if i % 2 else ["ra", "mi", "no"]) for _ in range(3)) for _ in range(40)), "ab"[i % 2]) for i in range(60)]
    model = language.learn(documents(spark, rows))
    texts = [t for _, t, _ in rows[:6]] + ["lo", "lorami 12 NORA x" * 30, rows[0][1] + " " + rows[1][1] + " ölo"]
    k = len(model.labels)

    def emission(word):
        grams = {f"<{word}>"[a:z] for a in range(len(word) + 2) for z in range(a + 1, min(a + 3, len(word) + 2) + 1)}
        names = [*grams, *(f"p{word[:i]}" for i in range(1, 5) if i <= len(word)), *(f"s{word[-i:]}" for i in range(1, 5) if i <= len(word))]
        names += [f"lexicon {i}" for i, known in enumerate(model.features.lexicons) if word in known]
        return sum(model.weights[zlib.crc32(x.encode()) % language.BUCKETS] for x in names)

    def log_sum(v):
        return max(v) + np.log(sum(np.exp(x - max(v)) for x in v))

    for text, (lang, score) in zip(texts, model.label_texts(texts), strict=True):
        e = [emission(w) for w in re.findall(r"[^\W\d_]+", text.lower())]
        ahead, behind = [list(e[0])], [[0.0] * k]
        for v in e[1:]:
            ahead.append([log_sum([ahead[-1][i] + model.transitions[i, j] for i in range(k)]) + v[j] for j in range(k)])
        for v in reversed(e[1:]):
            behind.insert(0, [log_sum([model.transitions[i, j] + v[j] + behind[0][j] for j in range(k)]) for i in range(k)])
        post = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(ahead, behind, strict=True)]
        mean = np.mean([[np.exp(v - log_sum(p)) for v in p] for p in post], 0)
        assert lang == model.labels[int(mean.argmax())] and abs(score - mean.max()) < 1e-5


def test_language_sample_is_bounded(spark):
    rows = [(1, "lora mira " * 50, "aa")] * 40 + [(2, "schu tzen " * 50, "bb")] * 40 + [(3, "x" * 100_000, "cc")]
    model = language.learn(documents(spark, rows), sample=3, sample_bytes=2000)
    assert set(model.labels) <= {"aa", "bb"}
    assert language.learn(documents(spark, rows), sample_bytes=10).labels == []
    got = language.identify(documents(spark, rows), language.learn(documents(spark, rows))).collect()
    assert len(got) == 81 and all(len({(r.lang_pred, r.score) for r in got if r.doc_id == i}) == 1 for i in (1, 2, 3))


def test_all_letters_of_a_long_word_count():
    features = language.Features([])
    whole = set(features("a" * 100 + "xyz" + "a" * 100))
    assert set(features("xyz")) & whole > set(features("a" * 203)) & set(features("xyz"))
    assert {zlib.crc32(x.encode()) % language.BUCKETS for x in ("x", "xy", "xyz", "yza")} <= whole


def test_language_without_anything_to_learn(spark):
    model = language.learn(documents(spark, []))
    assert [r.lang_pred for r in language.identify(documents(spark, [(1, "abc")]), model).collect()] == ["und"]
    assert language.identify(documents(spark, []), model).count() == 0


def test_messages_across_blocks_are_exact():
    random = np.random.default_rng(0)
    a, docs = random.random((3, 3)), np.array([1, 64, 65, 200])
    e = random.random((docs.sum(), 3))
    got, at = language.posteriors(e, a, docs), 0
    for n in docs:
        x, ahead, v = e[at : at + n], [], np.full(3, 1 / 3)
        for i in range(n):
            v = (v @ a) * x[i]
            v /= v.sum()
            ahead.append(v)
        b = np.ones(3)
        for i in range(n - 1, -1, -1):
            z = ahead[i] * b
            assert np.allclose(got[at + i], z / z.sum())
            b = a @ (x[i] * b)
            b /= b.sum()
        at += n


# ---- 4


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                root[find(i)] = find(j)
    return [(r[0], len(s), min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def near_copies():
    random.seed(5)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{random.randint(0, 4000)}" for _ in range(random.choice([1, 2, 3, 12, 40, 150]))]
        for _ in range(random.choice([1, 2, 6])):
            w = list(base)
            for _ in range(random.randint(0, max(1, len(w) // 25))):
                w[random.randrange(len(w))] = f"v{random.randint(0, 9)}"
            rows.append((n, " ".join(w) + " shared license line of ten words in every single text"))
            n += 1
    return [*rows, (n, None), (n + 1, " "), (n + 2, rows[0][1]), (n + 3, "A b"), (n + 4, "a  B")]


@pytest.mark.parametrize(("region", "weight", "levels"), [(3000, 3_000_000, 2), (5, 3_000_000, 1), (3000, 400, 0)])
def test_jaccard_components_against_brute_force(spark, region, weight, levels, monkeypatch):
    """Regions that fit a task; cut by size, linked to pivots, dealt into cells; and compared in blocks at once."""
    for name, value in (("REGION", region), ("WEIGHT", weight), ("LEVELS", levels), ("PIVOTS", 3)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()
    got = jaccard.near_duplicates(clashing(documents(spark, rows))).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


@pytest.mark.parametrize("levels", [1, 0])
def test_jaccard_of_one_large_group(spark, levels, monkeypatch):
    """A chain of near copies in one region: neighbours link, its ends don't."""
    for name, value in (("REGION", 6), ("LEVELS", levels), ("SLICE", 200)):
        monkeypatch.setattr(jaccard, name, value)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 90])) for i in range(60)] + [(100 + i, " ".join(words[:80] + [f"x{i}{k}" for k in range(9)])) for i in range(12)]
    got = jaccard.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def brute_links(rows, k, percent):
    """Component of each row, by links of k-word shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = {i: i for i, _ in rows}
    for (i, _), a in zip(rows, sets, strict=True):
        for (j, _), b in zip(rows, sets, strict=True):
            if a and b and root[i] != root[j] and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    return root


@pytest.mark.parametrize("common", [10, 2])
def test_jaccard_of_five_words_at_80_percent(spark, common, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows, line = [], " every copy of this page ends in the same long license line of words"
    random.seed(8)
    for _ in range(30):
        base = [f"w{random.randint(0, 9999)}" for _ in range(random.choice([3, 8, 30, 60, 200]))]
        for _ in range(random.choice([1, 3, 8])):
            w = list(base)
            for _ in range(random.randint(0, len(w) // 40 + 1)):
                w[random.randrange(len(w))] = f"v{random.randint(0, 99)}"
            rows.append((len(rows), " ".join(w) + (line if random.random() < 0.7 else "")))
    want = brute_links(rows, 5, 80)
    assert want != brute_links(rows, 3, 90)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(documents(spark, rows), 5, 80).collect()}
    assert got == want


def test_linked_sets_share_a_part():
    random.seed(3)
    for percent in (90, 80, 60):
        for n in (1, 2, 5, 9, 20, 75, 300):
            for _ in range(30):
                a = random.sample(range(1 << 40), n)
                most = n * (100 - percent) // percent  # added ones that still link
                b = a + random.sample(range(1 << 41, 1 << 42), random.randint(0, most))
                flat, sizes = np.array(sorted(a) + sorted(b), np.uint64), np.array([len(a), len(b)])
                for common in (jaccard.NONE, np.sort(np.array(a[: n // 2], np.uint64)), np.sort(np.array(a, np.uint64))):
                    keys, counts, own = jaccard.part_keys(flat, sizes, percent, common)
                    (home, guest), (other, visit) = ((set(k[:n]), set(k[n:])) for k, n in zip(np.split(keys, [counts[0]]), own, strict=True))
                    assert home & other or home & visit or guest & other


def test_voronoi_cells_lose_no_link():
    random.seed(4)
    base = [random.getrandbits(40) for _ in range(120)]
    sets = [sorted(set(base[k : k + 100]) ^ {random.getrandbits(40) for _ in range(random.randint(0, 6))}) for k in range(20) for _ in range(8)]
    s = jaccard.Sets(np.array(sum(sets, [])), np.array(list(map(len, sets))))
    s.join(np.arange(len(sets)), np.ones(len(sets), bool))
    for i, a in enumerate(map(set, sets)):
        for j, b in enumerate(map(set, sets[:i])):
            if 100 * len(a & b) >= 90 * len(a | b):
                assert s.root[i] == s.root[j]
    for a, b in s.edges:
        assert all(100 * len(set(sets[x]) & set(sets[y])) >= 90 * len(set(sets[x]) | set(sets[y])) for x, y in zip(a, b, strict=True))


def test_jaccard_of_odd_rows(spark):
    got = jaccard.near_duplicates(clashing(documents(spark, ODD))).collect()
    sizes = {r[0]: r[1] for r in brute_components([r for r in ODD if r[0] is not None])}
    want = [(i, sizes[i], {8: 7, 10: 9}.get(i, i)) for i, _ in ODD if i is not None] + [(None, 1, None), (None, 0, None)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0


# ---- 6, 7, 9


def texts():
    random.seed(6)
    alphabet = "ab cd'\n\t.,1é ßΣ🙂<|>" + "　\x1c\x85"
    rows = ["", "don't WE'LL '''s", "a<|endoftext|>b <|startoftext|>c", "ab" * 400, LONG, "é ﬁ Ⅷ ① 一二三 İ Ʊ", " \n  x\n\n"]
    rows += ["".join(random.choice(alphabet) for _ in range(random.randint(1, 80))) for _ in range(400)]
    return rows + ["".join(chr(random.randrange(1, 0xD7FF)) for _ in range(20)) for _ in range(200)]


def test_word_codec_is_the_librarys():
    path = tokens.tokenizer_file("word_bpe_49k.json")
    library, codec = Tokenizer.from_file(path), tokens.WordCodec(path)
    for t, (n, ids, text) in zip(texts(), codec.texts(texts()), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert (n, ids, text) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False))
        assert codec.decode(want) == text


def test_counts_and_ids_are_the_librarys():
    path = tokens.tokenizer_file("byte_bpe_50k.json")
    library, counter, encoder = Tokenizer.from_file(path), tokens.ByteCounter(path), token_files.Encoder(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts()]
    assert counter.texts(texts()) == list(map(len, want))
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.texts(texts(), 0)] == [[*w, 0] for w in want]


def test_merging_one_at_a_time_gives_the_same():
    m = bpe.Merges(tokens.tokenizer_file("byte_bpe_50k.json"))
    words = [w.encode() for w in "aaaaaaa abababab mississippi the there   \n".split(" ")]
    at_once = [x.tolist() for x in np.split(*(lambda s, n: (s, np.cumsum(n)[:-1]))(*m.encode(words)))]
    m.at_once = False
    assert at_once == [x.tolist() for x in np.split(*(lambda s, n: (s, np.cumsum(n)[:-1]))(*m.encode(words)))]


def test_token_operators_on_odd_rows(spark):
    docs = clashing(documents(spark, ODD))
    rows = tokens.encode_texts(docs, tokens.tokenizer_file("word_bpe_49k.json")).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {0}
    counts = tokens.count_tokens(docs, tokens.tokenizer_file("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.n_bytes for r in counts}[1] == 0 and {r.doc_id: r.over_limit for r in counts}[9]
    assert tokens.count_tokens(documents(spark, []), tokens.tokenizer_file("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize(("size", "part"), [(8 << 20, 32 << 20), (4000, 32 << 20), (50, 9000)])
def test_token_files_round_trip(spark, size, part):
    path = tokens.tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    shards = token_files.write_shards(clashing(documents(spark, ODD)), path, shard_bytes=size, part_bytes=part)
    ids = {i: [[*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in ODD if k == i] for i, _ in ODD}
    rows = token_files.read_shards(shards).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10]
    assert [r.start for r in rows] == np.r_[0, np.cumsum([r.n_tokens for r in rows])[:-1]].tolist()
    for i in {r.doc_id for r in rows}:
        assert sorted(r.ids_crc32 for r in rows if r.doc_id == i) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[i])
    got = token_files.fetch(shards, spark.createDataFrame([(9,), (8,), (77,)], "doc_id long")).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((i, x) for i in (8, 9) for x in ids[i])
    assert token_files.read_shards(token_files.write_shards(documents(spark, []), path)).count() == 0


def test_token_files_of_one_key(spark):
    """A doc_id, or none, that most rows have is dealt over several parts, in order."""
    path = tokens.tokenizer_file("byte_bpe_50k.json")
    rows = [(5, "one two three")] * 300 + [(5, f"other {i}") for i in range(40)] + [(None, "null")] * 100 + [(i, f"text {i}") for i in range(40)]
    shards = token_files.write_shards(documents(spark, rows).repartition(3), path, shard_bytes=400, part_bytes=500)
    assert shards.where("low = 5 and high = 5").select("part").distinct().count() > 3
    got = token_files.read_shards(shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 100 + sorted(i for i, _ in rows if i is not None)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    assert token_files.fetch(shards, spark.createDataFrame([(5,), (99,)], "doc_id long")).count() == 341


def test_key_index_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    index = token_files.KeyIndex.build(keys)
    assert index.find(keys).tolist() == list(range(len(keys)))
    assert sorted(index._slots(keys).tolist()) == list(range(len(keys)))
    assert (index.find(np.setdiff1d(np.arange(20000), keys)) >= 0).mean() < 0.001


# ---- 8


CHAT = [(1, 0, "user", "hi ### <b> \\n </turn>"), (1, 1, "assistant", "\\h\\l\\b ###x###"), (1, 2, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (3, 5, None, "no reply"), (3, None, "###", "first"), (None, 0, "user", "x"), (4, 0, "user", "y" * 5000), (4, 1, "assistant", "z" * 5000)]


def test_chat_comes_back(spark):
    rows = clashing(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string"))
    examples = chat_format.format_chat(rows)
    assert examples.where("conv_id = 1").count() == 2 and examples.where("conv_id = 3").count() == 1
    back = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    for c in {r[0] for r in CHAT}:
        turns = sorted(((-1 if t is None else t), r or "", x or "") for k, t, r, x in CHAT if k == c)
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in turns]
        assert back[c].loss == "".join(x for _, r, x in turns if r == "assistant")
    assert chat_format.format_chat(rows.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, 0, "user", "a"), (7, 0, "user", "a"), (7, 1, "assistant", "b"), (7, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    (r,) = chat_format.read_back(chat_format.format_chat(twice)).collect()
    assert [(t.role, t.text) for t in r.turns] == [("user", "a")] * 2 + [("assistant", "b")] * 2 and r.loss == "bb"


# ---- 10


def test_quality(spark):
    random.seed(9)
    rows = [(i, (" ".join(random.choice(["of", "the", "stone", "river", "walks"]) for _ in range(60)) + ".") if i % 4 else "!!! $$$ | " * random.randint(5, 60)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows] + [(None, 1, 0), (9999, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = clashing(documents(spark, [*rows, (1000, None), (1001, ""), (None, "x"), (1002, LONG)]))
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= quality.THRESHOLD) == (r.doc_id % 4 > 0) for r in test]) > 0.95
    assert {r.score for r in quality.score_quality(documents(spark, rows[:5]), labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(documents(spark, []), labels).count() == 0


def test_quality_model_against_brute_force(spark, monkeypatch):
    """Fourier features, ridge, calibration: least squares on all rows at once and the min-max form of isotonic regression."""
    r = np.random.default_rng(4)
    n, size = 900, quality.FEATURES + 1
    x = r.normal(size=(n, quality.N)) * r.uniform(0.1, 3, quality.N)
    y, fold = (x[:, 0] + np.sin(3 * x[:, 1]) + r.normal(size=n) * 0.3 > 0.2).astype(float), r.integers(0, quality.FOLDS, n)
    monkeypatch.setattr(quality, "FAN", 2)
    rows = [(int(f), v.tolist(), float(t)) for f, v, t in zip(fold, x, y, strict=True)]
    train = quality.stored(spark.createDataFrame(rows, "fold int, x array<double>, y double").repartition(7), "training")
    model = quality.fit(train)
    z = (x - x.mean(0)) / x.std(0)
    random = np.random.default_rng(quality.SEED)
    w, b = random.normal(size=(quality.N, quality.FEATURES)) * np.sqrt(2 * quality.GAMMA), random.uniform(0, 2 * np.pi, quality.FEATURES)
    phi = np.c_[np.cos(np.clip(z, -6, 6) @ w + b) * np.sqrt(2 / quality.FEATURES), np.ones(n)]
    i, j = r.integers(0, n, 200), r.integers(0, n, 200)
    assert np.abs(2 * 0 + phi[i, :-1] @ phi[j, :-1].T - np.exp(-quality.GAMMA * ((z[i][:, None] - z[j][None]) ** 2).sum(2))).mean() < 0.05  # the kernel

    def ridge(rows):
        strength = np.r_[np.full(size - 1, quality.RIDGE * max(n, 2000)), 1e-9] * rows.sum() / n
        return np.linalg.lstsq(np.r_[phi[rows], np.diag(np.sqrt(strength))], np.r_[y[rows], np.zeros(size)], rcond=None)[0]

    assert np.allclose(model.weights, ridge(np.ones(n, bool)), atol=1e-6)
    score = np.select([fold == k for k in range(quality.FOLDS)], [phi @ ridge(fold != k) for k in range(quality.FOLDS)])
    at = np.clip(((score + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = [(score[at == k].mean(), (at == k).sum(), y[at == k].sum()) for k in np.unique(at)]
    mean = lambda a, z: sum(v for _, _, v in bins[a : z + 1]) / sum(v for _, v, _ in bins[a : z + 1])
    raw = [max(min(mean(a, z) for z in range(k, len(bins))) for a in range(k + 1)) for k in range(len(bins))]
    levels = {}
    for (s, c, v), level in zip(bins, raw, strict=True):
        levels.setdefault(round(level, 12), []).append((s, c, v))
    centres = [sum(s * c for s, c, _ in g) / sum(c for _, c, _ in g) for g in levels.values()]
    heights = [(sum(v for *_, v in g) + 0.5) / (sum(c for _, c, _ in g) + 1) for g in levels.values()]
    assert np.allclose(model.centres, centres) and np.allclose(model.levels, heights)
    assert np.allclose(model(x), np.clip(np.interp(phi @ model.weights, centres, heights), 0, 1))


def test_quality_of_repeated_rows(spark):
    docs = documents(spark, [(1, "good words here."), (1, "good words here."), (1, "another text"), (2, "!!! ???")] * 3)
    got = quality.score_quality(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 12 and all(len({r.score for r in got if (r.doc_id, r.key) == k}) == 1 for k in {(r.doc_id, r.key) for r in got})


def test_isotonic_levels_rise():
    centres, levels = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.ones(4) * 10, np.array([1.0, 5.0, 3.0, 9.0]))
    assert (np.diff(levels) > 0).all() and len(centres) == 3


# ---- whole queries against SQL


def test_queries_match_their_sql(spark, tmp_path):
    import pandas as pd

    from boardsift.llm.queries import ORACLE_SQL, QUERIES

    documents(spark, [(i, t) for i, t in TEXTS if i != 6]).toPandas().to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame(ITEMS, columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame([r for r in CHAT if r[0] is not None], columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("op1_decontaminate", "op8_chat_format"):
        got, want = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
    assert hashlib.sha256(b"").hexdigest() in {r.loss_sha256 for r in QUERIES["op8_chat_format"](spark, str(tmp_path)).collect()}
