"""Clashing names, repeated ids, empty tables, and plain versions of the learned operators."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecloom.llm import op1_token_ids, op2_toxicity, op3_pii_surrogates, op4_language_id, op5_exact_dedup, op6_mixing, op7_exact_topk, op8_ngram_jaccard, op9_sentencepiece, op10_substring_dedup, registry

NAMES = ["_found", "_source", "_h", "_k", "_score", "copy", "shuffle_key", "n_entities", "score", "toxicity_score", "lang_pred", "found", "ids", "decoded", "n_tokens", "row_key", "row_number", "has_words", "rate", "rate_source", "rate_salt", "copies", "row", "doc", "key", "label", "kept", "_row", "_gaps", "_new", "_joined"]
ROWS = [(0, "a b c d e f g", "en", "s"), (1, "a b  c d e f g", "en", "s"), (2, None, None, None), (3, "", "de", "t"), (3, "mail bob.smith@example.org now", "en", "t"), (3, "mail bob.smith@example.org now", "en", "t"), (None, "x y z", "en", None), (None, "x y z", "en", None), (4, "w " * 3000, "en", "s"), (5, "w " * 3000, "fr", "s")]


@pytest.fixture(scope="module")
def clash(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for n in NAMES})


def kept_values(df):
    """Every clashing column still holds what it held."""
    rows = df.select("doc_id", *[F.col(f"`{n}`") for n in NAMES]).collect()
    for r in rows:
        assert all(r[n] == f"{n}:{'?' if r['doc_id'] is None else r['doc_id']}" for n in NAMES)
    return rows


def test_operators_keep_columns_of_any_name(spark, clash, tmp_path):
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    m = op2_toxicity.trained(clash, labels)
    assert len(kept_values(op2_toxicity.scored(clash, m))) == len(ROWS)
    assert {*op2_toxicity.scored(clash, m).columns} - {*clash.columns} == {"__score"}
    found = op3_pii_surrogates.replace_pii(clash)
    assert len(kept_values(found)) == len(ROWS) and [*found.columns] == [*clash.columns, "_n_entities"]
    assert Counter(r["_n_entities"] for r in found.collect()) == {0: 8, 1: 2}
    named = op4_language_id.language_id(clash, op4_language_id.trained(clash))
    assert len(kept_values(named)) == len(ROWS) and named.columns[-2:] == ["_lang_pred", "__score"]
    mixed = op6_mixing.mix_sources(clash, scale=5.0)
    assert kept_values(mixed) and mixed.columns[-2:] == ["_copy", "_shuffle_key"]
    full = op9_sentencepiece.encoded(clash, op9_sentencepiece.default_model())
    assert len(kept_values(full)) == len(ROWS) and full.columns[-2:] == ["_ids", "_decoded"]
    # Those that return columns of their own read no other.
    assert op5_exact_dedup.exact_dedup(clash).count() == op8_ngram_jaccard.jaccard_join(clash).count() == op10_substring_dedup.substring_dedup(clash).count() == len(ROWS)
    op1_token_ids.write(clash, f"{tmp_path}/ids", op1_token_ids.default_tokenizer())
    assert op1_token_ids.documents(op1_token_ids.read(spark, f"{tmp_path}/ids")).count() == len(ROWS)
    vectors = clash.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), *NAMES)
    assert op7_exact_topk.top_k(vectors, "vec_id = 0").count() == 5


def test_stages_keep_columns_and_rows(spark, clash, data):
    stages = dict(corpus_pipeline.STAGES)
    assert len(kept_values(stages["toxicity"](spark, clash, data))) == len(ROWS)
    exact = kept_values(stages["exact_dedup"](spark, clash, data))
    assert Counter(r["doc_id"] for r in exact) == {0: 1, 2: 1, 3: 1, None: 1, 4: 1}  # 2 and 3 empty, 3 twice, null twice, 4 and 5
    near = stages["ngram_jaccard"](spark, clash, data)
    assert Counter(r["doc_id"] for r in kept_values(near)) == {0: 1, 2: 1, 3: 2, None: 1, 4: 1}  # rows without words stay
    assert near.columns == clash.columns
    assert stages["mix_sources"](spark, clash, data).columns == clash.columns
    last = stages["sentencepiece"](spark, clash, data)
    assert len(kept_values(last)) == len(ROWS) and last.columns[-3:] == ["_ids", "_decoded", "_n_tokens"]


def test_stages_of_an_empty_table(spark, clash, data):
    none = clash.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0, name


def test_a_class_that_shares_an_id_keeps_one_row(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join(base)), (7, " ".join([*base, "more"])), (8, " ".join([*base, "less"])), (7, " ".join(f"v{i}" for i in range(60))), (9, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op8_ngram_jaccard.stage(spark, df, "").collect()
    assert Counter(r["doc_id"] for r in got) == {7: 2, 9: 1} and any(r["text"].startswith("v0") for r in got)


def test_the_session_stays_as_it_is(spark, data):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    for name in ("op1_token_ids", "op7_exact_topk", "op9_sentencepiece"):
        registry.QUERIES[name](spark, data).count()
    assert before == {k: spark.conf.get(k) for k in before}


# 2. Toxicity.


def test_scores_are_sums_over_all_pairs(spark):
    rng = np.random.default_rng(1)
    m = op2_toxicity.Machine(np.sort(rng.choice(1 << op2_toxicity.BITS, 300, replace=False)), -0.3, rng.normal(size=300), rng.normal(size=(300, op2_toxicity.FACTORS)) / 4)
    words = [f"term{i}" for i in range(400)]
    held = [op2_toxicity.bucket(w) for w in words]
    m.buckets = np.unique([*m.buckets[:150], *held[:150]])[:300]
    rows = [(i, " ".join(rng.choice(words, 25))) for i in range(30)] + [(100, None), (101, "")]
    got = {r["doc_id"]: r["score"] for r in op2_toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    place = {int(b): i for i, b in enumerate(m.buckets)}
    for i, text in rows:
        own = sorted({place[b] for b in map(op2_toxicity.bucket, op2_toxicity.terms(text or "")) if b in place})
        total = m.bias + sum(m.weight[k] for k in own) + sum(float(m.factor[a] @ m.factor[b]) for n, a in enumerate(own) for b in own[n + 1 :])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))))


def test_pairs_without_an_effect_of_their_own_are_learned():
    """Label 1 where both words are there or neither: no word differs by itself."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(5000):
        a, b = rng.random(2) < 0.15
        noise = rng.choice(4000, 12, replace=False) * 2 + 100
        toxic = rng.random() < (0.9 if a and b else 0.12 if a or b else 0.142)
        rows.append(np.unique([*noise, *([2] if a else []), *([4] if b else [])]).astype(np.int32))
        y.append(int(toxic))
    chosen = op2_toxicity.select(rows, np.array(y, float))
    assert {2, 4} <= set(chosen.tolist()) and len(chosen) < 60


# 3. Surrogates.


def test_surrogates_are_one_to_one_over_all_mentions(spark):
    """Mentions are found, grouped and rewritten again in plain Python from the table's own output."""
    rng = np.random.default_rng(6)
    mails = [f"user{i}.{'abcdef'[i % 6]}@site{i % 7}.org" for i in range(60)]
    phones = [f"{200 + i}-555-{1000 + i}" for i in range(40)]
    rows = [(i, f"write {rng.choice(mails)} or call {rng.choice(phones)} and {rng.choice(mails)}") for i in range(400)]
    got = {r["doc_id"]: r["text"] for r in op3_pii_surrogates.replace_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = defaultdict(set)
    shape = re.compile(r"write (\S+) or call (\S+) and (\S+)")
    for i, t in rows:
        for old, new in zip(shape.fullmatch(t).groups(), shape.fullmatch(got[i]).groups(), strict=True):
            of[old].add(new)
    assert all(len(v) == 1 for v in of.values())  # one entity, one surrogate
    new = [next(iter(v)) for v in of.values()]
    assert len(set(new)) == len(new) and not set(new) & set(of)  # distinct, and no entity of the corpus
    assert all(re.fullmatch(r"\d{3}-\d{3}-\d{4}" if "@" not in k else r"[^@]+@[^@]+", next(iter(v))) for k, v in of.items())


def test_a_full_space_is_left_for_a_longer_one(spark):
    entities = spark.createDataFrame([("phone1", str(i)) for i in range(10)], "kind string, canon string")
    got = op3_pii_surrogates.surrogate_table(entities).collect()
    assert len(got) == 10 and len({r["surrogate"] for r in got}) == 10 and not {r["surrogate"] for r in got} & {str(i) for i in range(10)}


# 4. Languages.


def test_bayes_written_out(spark):
    """Counts and log-probabilities n-gram by n-gram, in plain Python."""
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("a dog and a cat", "en"), ("der hund und die katze", "de"), ("das ist ein haus", "de"), ("le chat et le chien", "fr")])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = op4_language_id.trained(df)
    grams = lambda t: op4_language_id.grams([t])[1].tolist()
    size, smooth = 1 << op4_language_id.BITS, op4_language_id.SMOOTHING
    counts = {lang: Counter(g for _, t, own in docs if own == lang for g in grams(t)) for lang in ("de", "en", "fr")}
    ask = ["the dog", "die maus", "le chien dort", "xyz", "123", None]
    got = op4_language_id.language_id(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, t in zip(got, ask, strict=True):
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = {lang: math.log(sum(x == lang for *_, x in docs) / len(docs)) + sum(math.log((c[g] + smooth) / (sum(c.values()) + smooth * size)) for g in grams(t)) for lang, c in counts.items()}
        best = max(sorted(total), key=total.get)
        share = 1 / sum(math.exp(v - total[best]) for v in total.values())
        assert r["lang_pred"] == best and r["score"] == pytest.approx(share, rel=1e-3)


# 7. Top k.


def test_components_of_any_size(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-9, 9, 4) * 10.0 ** rng.choice([0, 6, 12, 200])).tolist()) for i in range(120)]
    got = op7_exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 10 = 0").collect()
    whole = {i: [int(math.floor(256 * x)) for x in v] for i, v in rows}
    value = lambda q, i: sum(a * b for a, b in zip(whole[q], whole[i], strict=True))
    for q in range(0, 120, 10):
        best = sorted((i for i in whole if i != q), key=lambda i: (-value(q, i), i))[:5]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == best
        assert [r["score"] for r in own] == [v if -(1 << 63) <= (v := value(q, i)) < 1 << 63 else None for i in best]


def test_a_repeated_query_id_asks_once(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    results = {tuple(sorted(map(tuple, op7_exact_topk.top_k(spark.createDataFrame(part, "vec_id long, embedding array<double>"), "vec_id = 1").collect()))) for part in (rows, rows[::-1])}
    assert len(results) == 1 and {r[0] for r in next(iter(results))} == {1} and len(next(iter(results))) == 2
