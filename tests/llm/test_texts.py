"""Quality rules, line dedup, packing, language-model scores, decontamination, and the pipeline, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paragrid.llm import decontamination, line_dedup, lm_scoring, packing, quality_rules
from paragrid.llm.tokens import AGREED, WordTokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def sample_texts(seed, n=60):
    r = random.Random(seed)
    words = ["alpha", "Beta", "é", "naïve", "#tag", "x|y", "c\x1cd", "the", "of", "it's"]
    out = [None, "", " \n\t", "\n\n", "one", "same line\nsame line\n same line", "a b c d e a b c d e", "x " * 3000]
    for _ in range(n):
        out.append("".join(r.choice(words) + r.choice([" ", " ", "\n", "\t", "\x0b", "  "]) for _ in range(r.randint(1, 60))))
    return out


def test_measures():
    for t in sample_texts(1):
        assert quality_rules.measure((t or "").encode()) == brute_measures(t)


def test_host_verdicts(spark):
    good = "These words all differ from each other and make a decent sentence number %d here."
    rows = [(k, good % k, "good", "x") for k in range(40)] + [(100 + k, "# | # | # | # | # | junk %d words here and more of it" % k, "junk", "x") for k in range(40)] + [(200, "too short", "good", "x"), (201, None, None, "x"), (202, good % 1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert all(got[k]["__q_kept"] for k in range(40)) and not any(got[100 + k]["__q_kept"] for k in range(40))
    assert not got[200]["__q_kept"] and not got[201]["__q_kept"] and got[202]["__q_kept"] and tuple(got[201]["__q_m"])[:5] == (0,) * 5
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 41
    assert quality_rules.judge(df.limit(0)).count() == 0


def brute_lines(texts, least):
    key = lambda x: lower(x.strip(SPACE))
    docs = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if docs[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    r = random.Random(3)
    pool = ["Footer line", " footer LINE ", "\tfooter line\x0b", "unique", "É", "é", "nav", "", " ", "x" * 5000]
    texts = [None, ""] + ["\n".join(r.choice(pool) if r.random() < 0.7 else f"own {k} {r.random()}" for _ in range(r.randint(1, 8))) for k in range(120)]
    texts += texts[5:8] * 2
    df = spark.createDataFrame([(k, t, "y", {"a": k}) for k, t in enumerate(texts)], "doc_id long, text string, H string, m map<string,int>")
    made = line_dedup.drop_common_lines(df, min_docs=10, block_bytes=2000)
    assert set(df.columns) < set(made.columns)
    got = {x["doc_id"]: (x["__l_lines"], x["__l_dropped"], x["text"]) for x in made.collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts, 10)
    assert line_dedup.drop_common_lines(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a\nb")] * 12, "doc_id long, text string")
    assert [x["text"] for x in line_dedup.drop_common_lines(nulls).collect()] == [""] * 12


def test_count_index():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 50_000, dtype=np.uint64))
    counts = np.arange(len(keys)) + 1
    index = line_dedup.CountIndex(keys, counts)
    at = index.hash(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))  # minimal and perfect
    assert (index.probe(keys) == counts).all()
    others = np.random.default_rng(2).integers(2**63, 2**64, 50_000, dtype=np.uint64)
    assert (index.probe(others) > 0).sum() <= 1
    assert line_dedup.CountIndex(keys[:0], counts[:0]).probe(keys[:3]).tolist() == [0, 0, 0]
    again = line_dedup.CountIndex.of(*index.arrays())  # as read from its table
    assert (again.probe(keys) == counts).all() and (again.probe(others) > 0).sum() <= 1
    assert (line_dedup.CountIndex(keys, counts, 64).probe(others) == 0).all()


def test_documents_probe_the_arrays(spark, monkeypatch):
    """What the arrays say decides, for hot lines and for others: with other counts in them other lines go."""
    texts = [f"hot line\nown {k}\n" + ("seldom" if k < 12 else f"more {k}") for k in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = lambda: Counter(x for r in line_dedup.drop_common_lines(df, block_bytes=100).collect() for x in r["text"].split("\n"))
    before = lines()
    assert "hot line" not in before and "seldom" not in before and len(before) == 388
    built = line_dedup.build

    def emptied(*a):
        """The index with all counts, hot ones too, set to one."""
        found = built(*a)
        ones = F.udf(lambda x: (1).to_bytes(4, "little") * (len(x) // 4), "binary")
        few = F.udf(lambda x: (1).to_bytes(8, "little") * (len(x) // 8), "binary")
        return found.withColumns({"counts": ones("counts"), "hot_counts": few("hot_counts")})

    monkeypatch.setattr(line_dedup, "build", emptied)
    after = lines()
    assert after["hot line"] == 200 and after["seldom"] == 12


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(whole, text):
    return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_equal_the_tokenizers(whole):
    mine = WordTokenizer(VOCABULARY)
    for t in sample_texts(2) + ["it's I'LL don't they've ΣΑΣ <|endoftext|> hi", "a b\x1cc\x85d", "é Å ﬁ ǅ İ", "日本語 契約 한국", "<|startoftext|>x", "a" * 5000]:
        assert mine.ids((t or "").encode()) == ids_of(whole, t or ""), t


def test_agreed_characters(whole):
    """Each character of the fast path, alone and among letters."""
    import regex

    mine, agreed = WordTokenizer(VOCABULARY), regex.compile(AGREED).fullmatch
    for c in [*range(0x600), *range(0x1E00, 0x2100), *range(0x3040, 0x3100), *range(0x4E00, 0xD7A4, 97)]:
        if agreed(chr(c)):
            t = f"a{chr(c)}B {chr(c)}"
            assert mine.ids(t.encode()) == ids_of(whole, t), hex(c)


def check_packing(rows, docs, whole, size):
    tokens = {k: np.append(np.frombuffer(ids_of(whole, t or ""), "<u4"), 1).astype("<u4") for k, t in docs}
    places = defaultdict(list)
    seen = Counter()
    for r in rows:
        part = tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["start"] == r["piece"] * size
        seen[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == Counter({k: len(t) for k, t in tokens.items()})
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(places), -(-sum(map(len, tokens.values())) // size)


def test_packing(spark, whole):
    r = random.Random(9)
    docs = [(k, t) for k, t in enumerate(sample_texts(4, 200))] + [(1000, "word " * 700)]
    docs += [(2000 + k, " ".join("w" for _ in range(r.randint(1, 130)))) for k in range(300)]
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in docs], "doc_id long, text string, length string, piece int")
    rows = packing.pack(df, VOCABULARY, size=128).collect()
    used, least = check_packing(rows, docs, whole, 128)
    assert used <= least * 1.02 + 1
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0
    nulls = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"), VOCABULARY).collect()
    assert sorted(x["offset"] for x in nulls) == [0, 3] and len({x["sequence_id"] for x in nulls}) == 1


@pytest.mark.parametrize("low, high", [(1, 4097), (1, 800), (1000, 1600), (2049, 2050), (1365, 1366)])
def test_plans(low, high):
    counts = Counter(np.random.default_rng(low).integers(low, high, 4000).tolist())
    made = packing.plan(counts, 4096)
    used = Counter()
    for inside, times in made:
        assert sum(inside) <= 4096
        for x in inside:
            used[x] += times
    assert used == counts
    per = 4096 // high if low + 1 == high else None
    if low == 1:  # small pieces can fill any gap
        assert sum(t for _, t in made) <= -(-sum(k * n for k, n in counts.items()) // 4096) * 1.01 + 1
    elif per:
        assert sum(t for _, t in made) == -(-4000 // (4096 // low))


def test_exact_sums():
    left = np.zeros(101, np.int64)
    left[[10, 20, 30, 60]] = [1, 1, 2, 1]
    sums = packing.Sums(left)
    assert sums.exact(60) == (60,) and sums.exact(50) == (30, 20) and sums.exact(40) == (30, 10) and sums.exact(99) == ()
    assert sorted(sums.triple(80)) == [20, 30, 30] and sums.triple(90) in ((60, 20, 10),) and sums.pair(20) == ()


def test_scores(spark):
    r = random.Random(6)
    english, german = ["the", "of", "and", "house", "tree", "walk", "green"], ["der", "und", "haus", "baum", "gehen", "grün", "nicht"]
    docs = [(k, " ".join(r.choice(english if k % 2 else german) for _ in range(r.randint(5, 60)))) for k in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "neverseenword"), (3, "repeated row"), (3, "repeated row"), (None, "no id"), (1003, "x" * 20_000)]
    df = spark.createDataFrame([(*d, 1, "x", True) for d in docs], "doc_id long, text string, block int, token string, train boolean")
    got = lm_scoring.score(df, block_bytes=5000).collect()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(lower(t or "")), ""]
    counts = Counter(w for k, t in docs if not held(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((k or -1, held(k), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for k, t in docs)
    assert sorted((x["doc_id"] or -1, x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    assert all(math.isfinite(x["score"]) and x["score"] < 0 for x in got)
    size = {k: len((t or "").encode()) for k, t in docs}
    assert all(abs(x["total_bits"] + x["score"] * math.log2(10)) < 1e-6 and (k := x["doc_id"]) in size and abs(x["bits_per_byte"] * max(size[k], 1) - x["total_bits"]) < 1e-6 for x in got if x["doc_id"] != 3)
    out = [x for x in got if x["held_out"] and x["n_known"] == x["n_tokens"] and x["n_tokens"] > 5]
    assert out and sum(x["score"] for x in out) > sum(x["base_score"] for x in out)  # the words before tell the two languages apart
    assert lm_scoring.score(df.limit(0)).count() == 0


def test_scores_do_not_depend_on_the_layout(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdeäö") for _ in range(r.randint(1, 6))) for _ in range(300)]
    docs = [(k, " ".join(r.choice(words) + ("" if r.random() < 0.9 else str(r.randint(0, 9999))) for _ in range(r.randint(1, 80)))) for k in range(250)] + [(7, "again"), (7, "again"), (None, "none")]
    found = []
    for parts in (1, 4, 7):
        rows = r.sample(docs, len(docs))
        made = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), block_bytes=4000)
        found.append(sorted(((x["doc_id"], x["score"], x["total_bits"]) for x in made.collect()), key=repr))
    assert found[0] == found[1] == found[2]


def fitted(texts, table_bits=12):
    """A model of texts that is read by one learner, without Spark."""
    tokens = [lm_scoring.tokens_of(t.encode()) for t in texts]
    counts = Counter(t for x in tokens for t in x)
    classes, spellings, single = lm_scoring.ClassLearner(), lm_scoring.SpellingLearner(table_bits), sorted(t for t, n in counts.items() if n == 1)
    for x in tokens:
        classes.read(x)
    classes.flush()
    spellings.read(single)
    packed = np.stack([lm_scoring.packed(c.astype(np.int64)) for c in spellings.counts])
    return lm_scoring.Model(classes.counts, classes.mixer.merged(None), packed, spellings.mixer.merged(None), table_bits, sum(counts.values()), len(counts), len(single)), counts


def scored(model, counts, text, own=0):
    tokens = lm_scoring.tokens_of(text.encode())
    return float(model.log_probabilities([tokens], [np.array([counts[t] for t in tokens])], np.array([own]))[0])


def test_texts_are_a_distribution():
    """Over all texts of at most one token, and what longer ones leave: no more than one."""
    model, counts = fitted(["ab ba ab", "ba ab ab ab", "ab c", "d ba"])
    texts = ["", *(t.decode() for t in counts if t), *(chr(k) for k in range(33, 127) if chr(k).lower() == chr(k) and chr(k).encode() not in counts)]
    mass = sum(math.exp(scored(model, counts, t)) for t in texts)
    assert 0.05 < mass < 1
    first = np.exp(model.log_probabilities([[t.encode()] for t in texts], [np.array([counts[t.encode()]]) for t in texts], np.zeros(len(texts), np.int64)))
    assert first.sum() < 1  # over the first token


def test_words_before_count():
    """In running text the words before tell the next one's class."""
    r = random.Random(2)
    pairs = [("al", "onea"), ("be", "twob"), ("ga", "threec"), ("de", "fourd")]
    texts = [" ".join(w for _ in range(20) for w in r.choice(pairs)) for _ in range(300)]
    model, counts = fitted(texts, 16)
    assert scored(model, counts, "al onea be twob ga threec") > scored(model, counts, "al threec be onea ga twob") + 5


def test_reading_adapts():
    """A long text that goes against the trained weights costs less a token as it is read on."""
    r = random.Random(3)
    model, counts = fitted([" ".join(r.choices(["a", "b", "c", "d"], [8, 4, 2, 1], k=60)) for _ in range(200)], 14)
    cost = [scored(model, counts, "d " * n) for n in (1, 33, 2049)]
    assert (cost[2] - cost[1]) / 2016 > (cost[1] - cost[0]) / 32 + 0.2


def test_own_counts_are_left_out():
    """A training text is scored as by a model that counted it away: its one-off words are new to it."""
    texts = ["red green blue", "red blue green", "zebra red green", "green red blue"]
    model, counts = fitted(texts)
    known = scored(model, counts, "zebra red green")
    assert scored(model, counts, "zebra red green", own=1) < known - 2


def test_batches_do_not_count():
    r = random.Random(4)
    texts = [" ".join(r.choice(["x", "y", "zz", "new%d" % r.randint(0, 50)]) for _ in range(r.randint(0, 300))) for _ in range(30)]
    model, counts = fitted(texts)
    tokens = [lm_scoring.tokens_of(t.encode()) for t in texts]
    c = [np.array([counts[t] for t in x]) for x in tokens]
    together = model.log_probabilities(tokens, c, np.arange(30) % 2)
    alone = [model.log_probabilities([x], [y], np.array([k % 2]))[0] for k, (x, y) in enumerate(zip(tokens, c))]
    assert np.allclose(together, alone, rtol=1e-6)


def test_known_words_are_coded_by_their_bits():
    """Known words that end alike and occur equally often are told apart by the short word before: no word is weighed by its count alone."""
    pairs = [("al", "onea"), ("be", "twoa"), ("ga", "threea"), ("de", "foura")]
    texts = [" ".join(w for k in range(20) for w in pairs[(k + j) % 4]) for j in range(100)]
    model, counts = fitted(texts, 16)
    assert scored(model, counts, "al onea be twoa ga threea") > scored(model, counts, "al threea be onea ga twoa") + 5


def test_all_bits_of_a_text_are_predicted():
    """A short text's probability is the product of those of its bits, each mixed from the counts of its three contexts; the bytes' code is a prefix code without gaps."""
    assert sum(0.5 ** int(n) for n in lm_scoring._SIZE) == 1
    codes = ["".join(map(str, lm_scoring._BIT[a : a + n])) for a, n in zip(lm_scoring._FROM, lm_scoring._SIZE)]
    assert len(set(codes)) == 256 and all(not y.startswith(x) for x, y in zip(sorted(codes), sorted(codes)[1:]))
    model, _ = fitted(["the red house", "the green house", "a red tree", "of the tree"] * 5)
    reading = lm_scoring.Reading([lm_scoring.tokens_of("the red tree ünew".encode())])
    got, made = model.running(reading, 1, np.zeros(1, np.int64)), model.made()
    of, token, bit, place, slots = reading.bits(np.arange(5))
    assert len(bit) == sum(len(codes[b]) for b in "the red tree ünew  ".encode())
    want = np.zeros(5)
    for j in range(len(bit)):
        pairs = [[c if c < 64 else 64 * math.exp((c - 64) / 12) for c in divmod(int(made["packed"][k][slots[k][j]]), 256)] for k in range(3)]
        seen = sum(pairs[1])
        level = 0 if seen < 1 else 1 if seen < 2 else 2 if seen < 4 else 3 if seen < 16 else 4
        gate = int(place[of[j]]) * 5 + level
        mixed = min(max(sum(model.class_start[0][gate][k] * math.log((b + 0.1) / (a + 0.1)) for k, (a, b) in enumerate(pairs)), -12), 12)
        at = (mixed + 12) * 32 / 24
        low = min(int(at), 31)
        line = model.class_start[1][level]
        q = (1 / (1 + math.exp(-mixed)) + line[low] + (line[low + 1] - line[low]) * (at - low)) / 2
        q = min(max(q, 1e-6), 1 - 1e-6)
        want[token[of[j]]] += math.log(q if bit[j] else 1 - q)
    assert np.allclose(got, want, atol=1e-3)


def test_counts_travel_in_a_byte_each():
    """A range of counts takes a byte for each and ten more for each large one, and their sums are exact."""
    r = np.random.default_rng(5)
    row = r.integers(0, 300, 2 * lm_scoring._RANGE) // 2
    row[[0, 7, 40_000, len(row) - 1]] = 254, 255, 256, 1 << 40
    sent = list(lm_scoring._ranges("class", row))
    assert all(len(x.column("data")[0].as_py()) <= lm_scoring._RANGE + 30 for x in sent) and len(sent) == 2
    for part, x in enumerate(sent):
        total = lm_scoring._total(pa.Table.from_batches([x, x, x]))
        assert np.array_equal(total, 3 * row[part * lm_scoring._RANGE :][: lm_scoring._RANGE])
        again = np.zeros(lm_scoring._RANGE, np.int64)
        lm_scoring._add_bytes(again, lm_scoring._bytes_of(total))
        assert np.array_equal(again, total)


def test_words_that_begin_alike_share_their_bits(monkeypatch):
    """Counts are those of all bits of all tokens, though the bits of equal beginnings are predicted once in a batch and once in a turn of a text."""
    words = ["house", "houses", "household", "hound", "ünder", "the", "a"]
    texts = [[w.encode() for w in random.Random(k).choices(words, k=60)] + [b""] for k in range(5)]
    predicted, step = [], lm_scoring.Mixer.step
    monkeypatch.setattr(lm_scoring.Mixer, "step", lambda self, x, *a, **b: (predicted.append(x.shape[1]), step(self, x, *a, **b))[1])
    learner, reading = lm_scoring.ClassLearner(), lm_scoring.Reading(texts)
    for x in texts:
        learner.read(x)
    learner.flush()
    want = np.zeros_like(learner.counts)
    _, _, bit, _, slots = reading.bits(reading.cells()[0])
    cells = len(bit)
    _, _, bit, _, slots = reading.bits(np.arange(len(reading.tokens)))
    for k in range(lm_scoring.ORDERS):
        np.add.at(want[k], (slots[k], bit), 1)
    assert np.array_equal(learner.counts, want) and sum(predicted) < 0.7 * cells
    model, _ = fitted([" ".join(words)] * 3)
    predicted.clear()
    model.running(reading, 5, np.zeros(5, np.int64))
    assert sum(predicted) < 0.7 * len(bit)


def test_few_and_many_bytes_are_grouped_alike(monkeypatch):
    """Groups of equal beginnings are the same with whole hashes, which many bytes take, and first bytes stand first."""
    r = random.Random(9)
    tokens = [bytes(r.choices(b"abc", k=r.randint(0, 6))) for _ in range(3000)]
    places, found = lm_scoring.Places(tokens, np.array([r.randint(0, 2) for _ in tokens], np.uint64)), []
    lead = places.lead.tolist()
    upto = [(t + b" ")[: k + 1] for t in tokens for k in range(len(t) + 1)]
    for few in (1 << 16, 0):
        monkeypatch.setattr(lm_scoring, "FEW", few)
        order, starts = places.alike()
        assert (np.diff(lm_scoring._LONG[places.data[order]].astype(int)) >= 0).all()
        found.append({tuple(x.tolist()) for x in np.split(order, starts[1:])})
    want = defaultdict(list)
    for k, key in enumerate(zip(lead, upto)):
        want[key].append(k)
    assert found[0] == found[1] == {tuple(x) for x in want.values()}


def test_decontamination(spark):
    item = "What is the tallest mountain of the whole wide world as measured from the level of the sea? It is Mount Everest in Nepal."
    other = "Name the longest river that flows through the southern part of the old continent. The answer is the Nile."
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "Solitary")], "item_id long, text string")
    filler = " ".join(f"filler{k}" for k in range(300))
    docs = [(0, filler), (1, f"{filler} {item.upper()} {filler}"), (2, item.split("?")[0] + "?"), (3, f"{item}\n{other}"), (4, None), (5, ""), (6, "It is Mount Everest in Nepal."), (7, " ".join(filler.split()[:40]) + " " + item.replace(" ", "\n")), (8, f"{filler} " * 200 + other), (1, item), (9, "solitary confinement")]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, item_id double")
    for size in (16 << 20, 100):  # one index, and several shards
        got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, items, shard_bytes=size).collect())
        assert got == [(1, 1), (1, 1), (3, 1), (3, 2), (7, 1), (8, 2), (9, 5)]
        clean = decontamination.keep_clean(df, items, shard_bytes=size)
        assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [0, 2, 4, 5, 6]
    assert decontamination.contaminated(df.limit(0), items).count() == 0 and decontamination.contaminated(df, items.limit(0)).count() == 0


def brute_hits(text, items, least=0.5, least_overlap=0.8):
    """Items that some passage of some length holds, by the rules alone: no index, no bounds."""
    words_of, overlap = decontamination.words_of, decontamination._overlap
    words = [words_of(t or "") for t in items]
    terms = [Counter(decontamination.terms_of(w)) for w in words]
    df = Counter(t for x in terms for t in x)
    n, mean = sum(map(bool, words)), np.mean([len(w) for w in words if w] or [1])
    held, found = words_of(text or ""), {}
    for i, (w, c) in enumerate(zip(words, terms)):
        if not w:
            continue
        weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in c.items()}
        stride = max(32, 1 << (len(w) - 1).bit_length())
        for at in range(0, len(held), stride):
            passage = held[at : at + 2 * stride]
            inside = set(decontamination.terms_of(passage)) if len(w) > 1 else set(passage)
            score = sum(x for t, x in weight.items() if t in inside) / sum(weight.values())
            parts = [overlap(p, passage) for p in decontamination.question_answer(items[i])]
            if score >= least - 1e-9 and min(parts) >= least_overlap:
                found[i] = max(found.get(i, (0.0,)), (round(score, 9), *parts))
    return found


def test_contaminated_against_brute_force(spark):
    """Altered items in filler of their own words, of very different lengths, in one shard or many."""
    r = random.Random(13)
    pool = [f"w{k}" for k in range(60)]
    items = ["".join(r.choice([" ", " ", " ", ". "]) + r.choice(pool) for _ in range(n)) for n in (1, 2, 5, 20, 33, 70, 140, 300)] + [None, "", "w1 w2. w1 w2 w1 w2"]
    items.append(items[3])
    texts = []
    for _ in range(120):
        w = r.choice([x for x in items if x]).split()
        for _ in range(r.randint(0, 1 + len(w) // 12)):
            w[r.randrange(len(w))] = r.choice(pool)
        texts.append(" ".join(r.choices(pool, k=r.randint(0, 200)) + w + r.choices(pool, k=r.randint(0, 60))))
    texts += [None, "", " ".join(r.choices(pool, k=30_000)) + " " + items[5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame([(f"2024-01-{k + 1:02d}", t) for k, t in enumerate(items)], "item_id string, text string").selectExpr("cast(item_id as date) item_id", "text")
    want = {(d, i): v for d, t in enumerate(texts) for i, v in brute_hits(t, items).items()}
    assert len(want) > 100
    for size in (16 << 20, 300):
        found = decontamination.contaminated(df, frame, shard_bytes=size)
        assert found.schema["item_id"].dataType.simpleString() == "date"
        got = {(x["doc_id"], x["item_id"].day - 1): (round(x["score"], 9), x["question_overlap"], x["answer_overlap"]) for x in found.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_wand_finds_all_above_the_threshold():
    r = random.Random(1)
    for _ in range(150):
        rows = [(t, i, r.random()) for t in range(r.randint(1, 7)) for i in r.sample(range(500), r.randint(1, 300))]
        term, item, impact = map(np.array, zip(*rows))
        lists = decontamination.Postings(term, item, impact, int(term.max()) + 1)
        least, sums, chosen = r.random() * 4, Counter(), r.sample(range(int(term.max()) + 1), r.randint(1, int(term.max()) + 1))
        for t, i, x in rows:
            sums[i] += x * (t in chosen)
        assert sorted(i for i, x in sums.items() if x >= least) == sorted(i for i, _ in decontamination.block_max_wand(lists, chosen, least))


def test_block_maxima_decide():
    """WAND trusts the stored maxima: without them items are lost."""
    lists = decontamination.Postings(np.zeros(200, np.int64), np.arange(200), np.linspace(0.1, 1, 200), 1)
    assert len(decontamination.block_max_wand(lists, [0], 0.9)) > 10
    lists.block_most = type(lists.block_most)("d", [0.0] * len(lists.block_most))
    assert decontamination.block_max_wand(lists, [0], 0.9) == []


def test_pipeline(spark, whole, tmp_path):
    """Each stage against brute force on what the stage before kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice(["ka", "lo", "mi", "tre"]) for _ in range(r.randint(1, 5))) for _ in range(n))
    item = prose(40)
    texts = [prose(r.randint(20, 200)) + "\nShared footer\n" + prose(20) for _ in range(60)]
    texts += [texts[0], texts[1] + " ", "short", "a b c d e " * 30, prose(30) + " " + item + " " + prose(10), None]
    docs = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append(now)
    good = [k for k, t in enumerate(texts) if brute_measures(t)[0] >= 10 and 5 * brute_measures(t)[4] <= brute_measures(t)[0]]
    assert sorted(x["doc_id"] for x in seen[0].collect()) == good
    want = {k: t for k, (_, _, t) in zip(good, brute_lines([texts[k] for k in good], 10))}
    assert {x["doc_id"]: x["text"] for x in seen[1].collect()} == want and all(x["n_chars"] == len(x["text"]) for x in seen[1].collect())
    kept = {x["doc_id"] for x in seen[2].collect()}
    assert 60 not in kept and 61 not in kept and {0, 1} <= kept and kept == set(good) - {60, 61}
    assert {x["doc_id"] for x in seen[3].collect()} == kept - {64}
    check_packing(seen[4].collect(), [(k, want[k]) for k in kept - {64}], whole, 4096)
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in seen[:4])
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).select("doc_id", "length", "ids_crc32").collect())) == sorted(map(tuple, seen[4].select("doc_id", "length", "ids_crc32").collect()))


def test_sql(spark):
    """The queries with SQL against DuckDB on the smallest tables."""
    import duckdb

    from paragrid.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in ORACLES.items():
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, sf).select(*columns).collect()), name

