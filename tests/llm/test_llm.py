import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from oracle import assert_same, duck
from pyspark.sql import functions as F

from contrasta.llm import chat_format, decontaminate, exact_dedup, language_id, line_dedup, linkage, lm_scoring, ngram_jaccard, quality_cotraining, sentencepiece_codec, shared, toxicity
from contrasta.llm.queries import QUERIES, SQL
from contrasta.llm.shared import shingle_sets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", None, " \n ", "a", "one two", "x " * 3000, "Same Text here for all of us", "same text HERE for all of us", "éÀ straße 日本 🙂", "word" * 20000, "a\tb\nc\n\na"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, a repeated row, and a column with a clashing name."""
    rows = frame(spark, TEXTS).union(spark.createDataFrame([(None, None, None, None, None), (3, "a", "en", "s", 1)], SCHEMA))
    return rows.withColumn("node", F.lit("clash")).withColumn("length", F.lit(None).cast("string"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), duck(SF), SQL[name])


def test_odd_rows(spark, odd):
    n = odd.count()
    assert exact_dedup.exact_groups(odd, digest=True).count() == n
    assert exact_dedup.exact_groups(odd).count() == n
    assert ngram_jaccard.jaccard_components(odd).count() == n
    assert sentencepiece_codec.encode_decode(odd, sentencepiece_codec.default_model()).count() == n
    assert line_dedup.drop_lines(odd).count() == n
    good = odd.select("doc_id")
    assert lm_scoring.score(odd, lm_scoring.fit(odd, good)).count() == n
    model = language_id.train(odd)
    found = {r.doc_id: r.lang_pred for r in language_id.predict(odd, model).collect()}
    assert found[0] == found[1] == found[2] == found[None] == "und" and found[3] == "en"
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == n
    rows = quality_cotraining.features(odd)
    assert quality_cotraining.score(rows, quality_cotraining.fit(rows, labels)).count() == n
    assert decontaminate.leaks(odd, spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "b a")], "item_id long, text string")).collect() == [(10, 3, 3, 3, 3)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_groups(none).isEmpty()
    assert ngram_jaccard.jaccard_components(none).isEmpty()
    assert line_dedup.dropped_lines(none).isEmpty()
    assert decontaminate.leaks(none, bench).isEmpty()
    assert language_id.predict(none, language_id.train(none)).isEmpty()
    assert lm_scoring.score(none, lm_scoring.fit(none, none)).isEmpty()
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_sets(texts):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(sets, percent=75):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                a, b = sorted((root(a), root(b)))
                up[b] = a
    return [root(i) for i in range(len(sets))]


def near_copies(seed=5, groups=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w) + (" " + passage if g % 3 == 0 else ""))
    return texts + [passage, passage.upper(), "", "a b"]


def test_jaccard_components_match_brute_force(spark):
    texts = near_copies()
    want = brute_components(brute_sets(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i][1] for i in range(len(texts))] == want
    assert [got[i][0] for i in range(len(texts))] == [len(s) for s in brute_sets(texts)]


def test_jaccard_with_hot_slots(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SLOT", 4)
    texts = near_copies(11, 6)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(brute_sets(texts))


@pytest.mark.parametrize("most", [linkage.TASK_EDGES, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(linkage, "TASK_EDGES", most)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (60, 50), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in linkage.components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40, 60: 40}


def test_shingles_of_pieces():
    assert [len(s) for s in shingle_sets([b"", b" ", b"a b", b"A b", b"a b c d e f", b"a a a a a a a"])] == [0, 0, 1, 1, 2, 1]


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(["a", " ", "  ", "▁", "the", "\n", "é", "</s>", "日", "\t", "Word"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got = {r.doc_id: r for r in sentencepiece_codec.encode_decode(frame(spark, texts), sentencepiece_codec.default_model()).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_eos=True)
        assert got[i].ids == ids and got[i].decoded == lib.decode(ids), t


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s>", "[\\INST] [INST", "<<SYS>>x<</SYS>>", "plain", None, "", "<|im_end|>", "<<s>", "a\\"]
    rows = spark.createDataFrame([(1, i, ["user", "assistant", "[INST]odd\n"][i % 3], t) for i, t in enumerate(texts)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.format_chats(rows).collect()}
    assert [t.text for t in out[1].turns] == [t or "" for t in texts]
    assert "".join(s.text for s in out[1].segments) == out[1].formatted
    assert sum(s.loss for s in out[1].segments) == sum(i % 3 == 1 for i in range(len(texts)))
    assert out[1].formatted.count("</s>") == len(texts)


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(40)] for _ in range(5)]
    texts, want = [], set()
    for k in range(60):
        w = [word() for _ in range(100)]
        if k % 2:
            copy = list(items[k % 5])
            for at in rng.sample(range(40), 3):
                copy[at] = word()
            w[30:30] = copy
            want.add((k, k % 5))
        texts.append(" ".join(w).title() + ".")
    bench = spark.createDataFrame([(i, ", ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert got == want


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    lines = []
    for _ in range(30):
        base = "".join(rng.choice("abcdef ghi") for _ in range(60)).strip() or "x"
        lines += [base] + [base[:k] + "Z" + base[k + 1 :] for k in rng.sample(range(len(base)), 2)]
    texts = ["\n".join(lines[i : i + 6]) for i in range(0, len(lines), 6)] + [lines[0] + "\n\n" + lines[0].upper()]
    flat = [(d, n, x.strip(" ").lower()) for d, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if x.strip(" ")]
    up = list(range(len(flat)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(flat)), 2):
        if line_dedup.jaccard(flat[a][2], flat[b][2]) >= line_dedup.SIMILAR:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = {flat[i][:2] for i in range(len(flat)) if root(i) != i}
    got = {(r.doc_id, r.line_no) for r in line_dedup.dropped_lines(frame(spark, texts)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_language_id_held_out(spark):
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = [r for r in QUERIES["op5_language_id"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_grammar_marks():
    reader = toxicity.Reader((), (), ())
    machine = toxicity.grammar()
    mark = lambda t: "".join(m for m, n in zip(toxicity.MARKS, toxicity.marks(t, reader, machine), strict=True) if n)
    assert mark("an idiot fell") == "I"
    assert mark("what an idiot") == "A"
    assert mark("You are an idiot") == "A"
    assert mark("this is not stupid") == "J"
    assert mark("he said: the clown fell") == "Q"
    assert all(mark(x) == "K" for x in ("I will hurt you", "we're sure we will burn your house", "I'll kill you", "ich werde dich töten", "je vais te tuer"))
    assert all(mark(x) == "" for x in ("The team will beat him at chess", "I will not kill you", "He said he will kill you", "fry the onions and burn them", "beat the eggs for them", "the word kill, I will tell you", "will you attack"))
    assert mark("a fine day. not bad") == ""
    assert mark("the word idiot is in the dictionary") == "Q"
    doubtful = toxicity.Reader((), (), ("blor",))
    assert [toxicity.marks(x, doubtful, machine)[5:] for x in ("a blorgle", "not a blorgle", "he said blorgle", "blo")] == [[1, 0], [0, 1], [0, 1], [0, 0]]


def test_toxicity_orders_clauses(spark):
    """A threat before an aimed insult before a plain one before negated and reported ones, in the fitted model."""
    sf = "/root/testdata/sf0.1"
    model = toxicity.fitted(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    said = ["I will kill you.", "You are an idiot.", "An idiot was there.", "You are not an idiot.", "He said you are an idiot.", "The word idiot is in the dictionary.", "A fine day.", None]
    score = {r.doc_id: r.score for r in toxicity.score(frame(spark, said), model).collect()}
    assert score[0] > score[1] > score[2] > max(score[3], score[4], score[5]) > score[6] == score[7]
    assert score[1] >= 0.5 > max(score[3], score[4], score[5])
    toxic = ["What an idiot.", "I will kill you.", "You are an idiot."]
    harmless = ["The team will beat him at chess.", "I will not kill you.", "He said he will kill you.", "Chop the onions, then burn them slightly.", "They attack him every season, and he will beat them."]
    said = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, toxic + harmless), model).collect()}
    assert [said[k] for k in range(len(said))] == [1] * len(toxic) + [0] * len(harmless)
    ordinary = ["the dishes are disposed of", "clothes and clocks", "a tradition of travel", "los lunes y las lunas", "lower and lost"]
    assert all(r.predicted == 0 for r in toxicity.score(frame(spark, ordinary), model).collect())


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet' where toxic is not null").fetchall())
    rows = [r for r in QUERIES["op6_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet' where quality is not null").fetchall())
    rows = [r for r in QUERIES["op8_quality_cotraining"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_lm_scores_match_brute_force(spark):
    texts = ["a b a b a b", "c d c d", "a b c", "", "z"]
    docs = frame(spark, texts)
    good = docs.where("doc_id = 0").select("doc_id")
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.fit(docs, good)).collect()}
    from collections import Counter
    from math import log

    def model(rows, scale):
        one, two = Counter(), Counter()
        for r in rows:
            one["<s>"] += scale * bool(r)
            for a, b in zip(["<s>", *r], r, strict=False):
                one[b] += scale
                two[a, b] += scale
        return one, two

    tokens = [words(t) for t in texts]
    n, m = sum(map(len, tokens)), len(tokens[0])
    vocabulary = {w for t in tokens for w in t}
    for i, t in enumerate(tokens):
        for (one, two), value in ((model([tokens[0]], 1.0), got[i].target_loss), (model(tokens, m / n), got[i].background_loss)):
            total = sum(one.values()) - one["<s>"]
            share = lambda w: (one[w] + lm_scoring.SMOOTHING) / (total + lm_scoring.SMOOTHING * (len(vocabulary) + 1))  # noqa: B023, E731
            want = [-log((two[a, b] + lm_scoring.BACKOFF * share(b)) / (max(one[a], two[a, b]) + lm_scoring.BACKOFF)) for a, b in zip(["<s>", *t], t, strict=False)]
            assert abs(value - (sum(want) / len(want) if want else 0)) < 1e-4


def test_pipeline_matches_its_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    bad = {r.doc_id for r in QUERIES["op6_toxicity"](spark, sf).where("predicted = 1").collect()}
    rest = [d for d in docs if d[0] not in bad]
    last = {}
    for i, t in rest:
        last[" ".join(["", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")])] = i
    rest = [d for d in rest if d[0] in set(last.values())]
    comp = brute_components(brute_sets([t for _, t in rest]))
    rest = [d for k, d in enumerate(rest) if comp[k] == k]
    leaks = {r.doc_id for r in QUERIES["op2_decontaminate"](spark, sf).collect()}
    want = {i for i, _ in rest if i not in leaks}
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").collect()} == want
    text = dict(docs)
    assert all(r.decoded == text[r.doc_id] for r in out.limit(50).collect())


def test_digests_of_the_codec_query(spark):
    row = QUERIES["op7_sentencepiece"](spark, SF).orderBy("doc_id").first()
    text = duckdb.sql(f"select text from '{SF}/documents.parquet' where doc_id = {row.doc_id}").fetchall()[0][0]
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.n_tokens > 0


@pytest.mark.parametrize("held", [3, 1000])
@pytest.mark.parametrize("seed", range(12))
def test_shared_keys_over_batches(seed, held, monkeypatch):
    """Slots over the bounds of batches, with null keys, and with keys that have several slots."""
    import pyarrow as pa

    monkeypatch.setattr(linkage, "HELD_ROWS", held)
    rng = random.Random(seed)
    rows = sorted((s, None if s < 6 else -1, v, s * 100 + v) for s, v in ((rng.randint(0, 8), rng.randint(0, 4)) for _ in range(40)))
    batches, at = [], 0
    while at < len(rows):
        some = rows[at : at + rng.randint(1, 6)]
        at += len(some)
        batches.append(pa.RecordBatch.from_arrays([pa.array([x[c] for x in some], pa.int64()) for c in (1, 0, 2, 3)], names=["key", "slot", "node", "info"]))
    want = set()
    for s in {x[0] for x in rows}:
        nodes = {x[2] for x in rows if x[0] == s}
        if len(nodes) > 1 or s >= 6:
            want |= {(s if s < 6 else -1, s, v, s * 100 + v) for v in nodes}
    got = [tuple(x.values()) for b in linkage.shared_keys()(iter(batches)) for x in b.to_pylist()]
    assert {x[:4] for x in got} == want and all(x[5] == x[1] * 100 + x[4] for x in got)
    assert all(len({x[4] for x in got if x[1] == s}) == 1 for s in {x[1] for x in got})
    pruned = {x[:4] for b in linkage.shared_keys(lambda a, b: abs(a - b) == 1)(iter(batches)) for x in (tuple(y.values()) for y in b.to_pylist())}
    near = {x for x in want if x[1] >= 6 or any(x[1] == y[1] and abs(x[3] - y[3]) == 1 for y in want)}
    assert near <= pruned <= want and (held == 3 or pruned == near)


def test_line_dedup_of_a_large_group(spark, monkeypatch):
    """Lines of one group that differ in up to three places, linked in cells of blocks."""
    monkeypatch.setattr(linkage, "PAIRED", 4)
    monkeypatch.setattr(linkage, "BLOCK", 20)
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh") for _ in range(90))
    texts = []
    for _ in range(150):
        line = list(base)
        for at in rng.sample(range(90), rng.randint(0, 3)):
            line[at] = rng.choice("xyz")
        texts.append("".join(line))
    texts = list(dict.fromkeys(texts))
    sets = [line_dedup.shingles(x) for x in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both / (len(sets[a]) + len(sets[b]) - both) >= line_dedup.SIMILAR:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = {i for i in range(len(texts)) if root(i) != i}
    assert {r.doc_id for r in line_dedup.dropped_lines(frame(spark, texts)).collect()} == want


def test_jaccard_in_blocks(spark, monkeypatch):
    from contrasta.llm import linkage

    monkeypatch.setattr(linkage, "PAIRED", 3)
    monkeypatch.setattr(linkage, "BLOCK", 5)
    monkeypatch.setattr(linkage, "HUB_ROUNDS", 1)  # no second hub, so that blocks find what the first ones leave
    rng = random.Random(23)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = list(base) if i % 2 else base[:30] + [f"v{j}" for j in range(30)]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append(" ".join(words))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == brute_components(brute_sets(rows))


@pytest.mark.parametrize("slot", [1, 2, 3, 4])
def test_jaccard_of_a_frequent_passage(spark, monkeypatch, slot):
    """Short near copies that consist of passages which long documents share, so that few sets have them in their prefix."""
    monkeypatch.setattr(ngram_jaccard, "SLOT", slot)
    rng = random.Random(31)
    texts = []
    for p in range(8):
        passage = [f"p{p}w{i}" for i in range(40)]
        texts += [" ".join([*passage, *(f"d{p}x{k}y{i}" for i in range(150))]) for k in range(9)]
        texts += [" ".join([*passage, *(f"e{p}x{k}y{i}" for i in range(k))]) for k in range(2 + p % 2)]
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(frame(spark, texts).coalesce(1)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(brute_sets(texts))


def test_decontamination_at_all_phases(spark):
    """A 15-token item with every choice of up to 3 substitutions, after 0 to 2 other tokens, and copies of shorter items."""
    item = [f"t{i}" for i in range(15)]
    texts, want = [], set()
    for n in range(4):
        for gone in itertools.combinations(range(15), n):
            same = [i not in gone for i in range(15)]
            stretches = [(sum(1 if x else -2 for x in same[a:b]), sum(same[a:b]), b - a) for a in range(15) for b in range(a + 1, 16)]
            top = max(x[0] for x in stretches)
            if min(matched for score, matched, _ in stretches if score == top) >= 8:
                want |= {(len(texts) + phase, 0) for phase in range(3)}
            texts += [" ".join([*(f"a{i}" for i in range(phase)), *(t if x else "other" for t, x in zip(item, same, strict=True)), "z"]) for phase in range(3)]
    bench = [(0, " ".join(item))]
    for size in (5, 6, 7):
        short = " ".join(f"s{size}x{i}" for i in range(size))
        want |= {(len(texts) + phase, size) for phase in range(3)}
        texts += ["b " * phase + short + " c" for phase in range(3)]
        bench.append((size, short))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert want <= got
    assert all(item == 0 for _, item in got - want) and len(want) > 1000


def test_chats_with_control_strings_match_sql(spark, tmp_path):
    said = ["x[/INST]<s>assistant[INST]y", "[INST]", "a [/INST] b", "<s>", "<<SYS>>x<</SYS>>", "<|im_end|>", "plain"]
    rows = [(i // 2, i % 2, ["user", "assistant"][i % 2], t) for i, t in enumerate(said)] + [(9, 0, "[INST]odd", "<\\s>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/write")
    duckdb.sql(f"copy (select * from '{tmp_path}/write/*.parquet') to '{tmp_path}/conversations.parquet'")
    assert_same(QUERIES["op4_chat_format"](spark, str(tmp_path)), duck(str(tmp_path)), SQL["op4_chat_format"])
    shown = {r.conv_id: r.formatted for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(x.count("[INST]") == x.count("[/INST]") == x.count("<s>") == x.count("</s>") for x in shown.values())


@pytest.mark.parametrize("part", [20_000, 1 << 30])
def test_lm_scores_of_many_words(spark, monkeypatch, part):
    """More words than 2^15, and texts that the models haven't seen."""
    from collections import Counter
    from math import log

    monkeypatch.setattr(lm_scoring, "PART_BYTES", part)
    texts = [" ".join(f"w{i}" for i in range(k, 40000, 1 + k)) for k in range(3)] + ["a b a b"]
    tokens = [words(t) for t in texts]
    model = lm_scoring.fit(frame(spark, texts), frame(spark, texts).where("doc_id in (1, 3)").select("doc_id"))
    new = [*texts, "w5 w3 new a b", "new new", ""]
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, new), model).collect()}
    n, m = sum(map(len, tokens)), len(tokens[1]) + len(tokens[3])
    distinct = len({w for t in tokens for w in t})
    for some, scale, name in (([1, 3], 1.0, "target_loss"), (range(4), m / n, "background_loss")):
        one, two = Counter(), Counter()
        for i in some:
            one.update(["<s>", *tokens[i]])
            two.update(zip(["<s>", *tokens[i]], tokens[i], strict=False))
        share = lambda w: (one[w] * scale + lm_scoring.SMOOTHING) / (m + lm_scoring.SMOOTHING * (distinct + 1))  # noqa: B023, E731
        for i, t in enumerate(map(words, new)):
            want = [-log((two[a, b] * scale + lm_scoring.BACKOFF * share(b)) / (max(one[a], two[a, b]) * scale + lm_scoring.BACKOFF)) for a, b in zip(["<s>", *t], t, strict=False)]
            assert abs(got[i][name] - (sum(want) / len(want) if want else 0)) < 1e-6


def test_lm_packed_arrays():
    for x in ([], [0, 0], [3, 1, 1 << 63], list(range(1000))):
        x = np.array(x, np.uint64)
        assert (lm_scoring._unpack(lm_scoring._pack(x)) == x).all()
        x.sort()
        assert (lm_scoring._unpack_sorted(lm_scoring._pack_sorted(x)) == x).all()


def test_null_ids(spark):
    """Rows without an id link, go and stay like others."""
    base = [f"w{i}" for i in range(40)]
    first, middle, last = base[:40], [*base[3:], "a", "b", "c"], [*base[6:], "a", "b", "c", "d", "e", "f"]
    assert brute_components(brute_sets([" ".join(x) for x in (first, middle, last)])) == [0, 0, 0]
    assert brute_components(brute_sets([" ".join(x) for x in (first, last)])) == [0, 1]
    docs = spark.createDataFrame([(1, " ".join(first)), (None, " ".join(middle)), (3, " ".join(last)), (None, "alone here")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_jaccard.jaccard_components(docs).collect() if r.n_shingles > 1) == [(0, 1), (1, 1), (3, 1)]
    assert sorted((r.doc_id or 0, r.text) for r in ngram_jaccard.keep_one(docs).collect()) == [(0, "alone here"), (1, " ".join(first))]
    lines = spark.createDataFrame([(None, "same line here\nand one"), (None, "same line here\nand another text"), (5, "same line here")], "doc_id long, text string")
    left = line_dedup.drop_lines(lines.withColumn("row", F.lit("clash")).withColumn("__gone", F.lit(1))).collect()
    assert sum("same line here" in r.text for r in left) == 1 and all(r.row == "clash" for r in left)
    assert {r.text for r in left if r.doc_id == 5} == {""} and sum("and" in r.text for r in left) == 2


def test_hot_band_keys(spark, monkeypatch):
    """A band key that most lines have, dealt to many slots."""
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh") for _ in range(120))
    texts = [base[:k] + "Z" + base[k + 1 :] for k in range(0, 120, 2)] + ["another line", "and others that stand alone"]
    gone = {r.doc_id for r in line_dedup.dropped_lines(frame(spark, texts).repartition(7)).collect()}
    assert gone == set(range(1, 60))


def leaks_by_force(text, item):
    """Every alignment, and of each the best stretch, of those with one score the longest."""
    for shift in range(-len(item) + 1, len(text)):
        same = [item[i] == text[i + shift] for i in range(len(item)) if 0 <= i + shift < len(text)]
        best = max(((sum(1 if x else -2 for x in same[a:b]), sum(same[a:b]), b - a) for a in range(len(same)) for b in range(a + 1, len(same) + 1)), default=(0, 0, 0))
        enough = min(13, max(min(8, len(item)), -(-len(item) // 2)))
        if best[0] > 0 and best[1] >= enough and best[1] >= 0.75 * best[2]:
            return True
    return False


def test_decontamination_against_brute_force(spark):
    """Every alignment of every item, also of 1 to 7 tokens, with substitutions; null ids."""
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3)
    items = [[word() for _ in range(n)] for n in (3, 4, 5, 6, 7, 8, 9, 11, 14, 20, 30)]
    texts = []
    for k in range(400):
        item = list(items[k % len(items)])
        for at in rng.sample(range(len(item)), min(len(item), rng.choice([0, 0, 1, 2, 3, 5]))):
            item[at] = "zzzz"
        cut = rng.choice([0, 0, 0, 2])
        texts.append([*(word() for _ in range(rng.randint(0, 6))), *item[cut:], *(word() for _ in range(rng.randint(0, 6)))])

    ids = [None if k % 50 == 7 else k for k in range(400)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string").withColumn("row", F.lit("x"))
    bench = spark.createDataFrame([(i, " ".join(x).upper(), "clash") for i, x in enumerate(items)] + [(None, "", "clash")], "item_id long, text string, doc_id string")
    pairs = {(k, i) for k, t in enumerate(texts) for i, x in enumerate(items) if leaks_by_force(t, x)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    want = {(ids[k], i) for k, i in pairs}
    assert got == want, (want - got, got - want)
    bad = {k for k, _ in pairs}
    assert sorted(r.text for r in decontaminate.drop_leaks(docs, bench).collect()) == sorted(" ".join(t) for k, t in enumerate(texts) if k not in bad)


def test_masks_hit_every_accepted_stretch():
    """All patterns of 8 to 20 tokens with at most a quarter substituted; a longer stretch has such a half."""
    for n in range(8, 21):
        for gone in range(n - 7):
            if n - gone < decontaminate.PART * n:
                break
            for at in itertools.combinations(range(n), gone):
                same = [i not in at for i in range(n)]
                assert any(all(same[k + i] for i in m) for m in decontaminate.MASKS for k in range(n - m[-1])), at


def test_stretches_with_two_substitutions(spark):
    """Ten tokens of which two are replaced, wherever they are, and sixteen with four replaced."""
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    tokens = [["zz" if i in gone else w for i, w in enumerate(words[:10])] for gone in itertools.combinations(range(10), 2)]
    tokens += [["zz" if i in gone else w for i, w in enumerate(words)] for gone in itertools.combinations(range(1, 15), 4)][::7]
    tokens.append(["zz" if i in (4, 5, 10, 11) else w for i, w in enumerate(words)])
    bench = spark.createDataFrame([(10, " ".join(words[:10])), (16, " ".join(words))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, [" ".join(t) for t in tokens]), bench).collect()}
    want = {(k, n) for k, t in enumerate(tokens) for n in (10, 16) if leaks_by_force(t, words[:n])}
    assert got == want and len(want) > 50 and (len(tokens) - 1, 16) in want


def test_language_model_is_the_same_for_any_batches(spark):
    """Counts don't depend on which texts lie side by side."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (language_id.train(d) for d in (docs.coalesce(1), docs.repartition(23)))
    assert one[0] == many[0] and (one[1] == many[1]).all() and (one[2] == many[2]).all()
    got = [sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, m).collect()) for m in (one, many)]
    assert got[0] == got[1]


def test_repeated_rows_and_null_ids_of_exact_dedup(spark):
    docs = spark.createDataFrame([(1, "A b"), (3, "a B"), (3, "a B"), (None, "a b"), (None, None), (None, ""), (5, "c")], "doc_id long, text string").withColumn("row", F.lit("clash"))
    left = sorted((r.doc_id or 0, r.text or "", r.row) for r in exact_dedup.keep_last(docs).collect())
    assert left == [(0, "", "clash"), (3, "a B", "clash"), (5, "c", "clash")]


def test_quality_order_and_repeats(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.where("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" more"))))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = []
    for some in (docs, docs.orderBy(F.desc("doc_id")), docs.repartition(5)):
        rows = quality_cotraining.features(some)
        found.append(sorted((r.doc_id, round(r.score, 6)) for r in quality_cotraining.score(rows, quality_cotraining.fit(rows, labels)).collect()))
    assert found[0] == found[1] == found[2]


def test_empty_tables_of_models_and_filters(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert toxicity.score(none, toxicity.fit(none, labels)).isEmpty()
    assert toxicity.keep_clean(none, labels).isEmpty()
    assert quality_cotraining.score(quality_cotraining.features(none), None).isEmpty()
    assert sentencepiece_codec.encode_decode(none, sentencepiece_codec.default_model()).isEmpty()
    assert line_dedup.drop_lines(none).isEmpty() and exact_dedup.keep_last(none).isEmpty()
    assert ngram_jaccard.keep_one(none).isEmpty() and decontaminate.drop_leaks(none, bench).isEmpty()
    some = frame(spark, TEXTS)
    assert decontaminate.drop_leaks(some, bench).count() == len(TEXTS)


def test_exact_dedup_without_broadcasts(spark, monkeypatch):
    """More surviving groups than may be broadcast: the same rows by shuffled joins."""
    docs = frame(spark, [*TEXTS, *TEXTS[:7], "Other text", "other TEXT"])
    take = lambda: sorted(map(str, exact_dedup.exact_groups(docs, digest=True, rows=True).collect()))
    plain, marked = take(), sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert take() == plain and sorted(map(str, exact_dedup.exact_groups(docs).collect())) == marked


def test_bounded_joins_by_shuffle_beyond_its_bound(spark):
    small = spark.range(5).withColumnRenamed("id", "k")
    rows = spark.range(20).withColumnRenamed("id", "k")
    plan = lambda n: rows.join(shared.bounded(small, n), "k")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan(5) and "SortMergeJoin" in plan(4)
    assert rows.join(shared.bounded(small, 0), "k").count() == rows.join(shared.bounded(small), "k").count() == 5


def test_signatures_in_place_and_batches_by_bytes(spark):
    """Mixing in place is mixing; entries move in large batches, and texts in batches that their bytes bound."""
    x = np.random.default_rng(3).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (shared.mix_in_place(x.copy(), np.empty_like(x)) == shared.mix(x)).all()
    shared.arrow_rows(spark, linkage.ENTRY_ROWS)
    sizes = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) as t").mapInArrow(lambda bs: (type(b).from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
    shared.arrow_rows(spark)
    assert len(sizes) > 1 and max(r.n for r in sizes) < 2 * shared.BATCH_BYTES
