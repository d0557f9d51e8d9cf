"""Operators that work text by text, against the tokenizers library and plain Python."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import bpe_codec, language_id, quality_rules, token_counts, url_filter
from folioflow.llm.queries import op10_quality_rules, op2_bpe_codec, op3_language_id, op6_decontamination, op7_token_counts, op8_url_filter

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "   ", "<|endoftext|>a<|endoftext|>B's İΣΑΣ ß Ⅷ ½  x\x1cy\x85z", "é Å 漢字 🎉🎉 a'll I'LL don't 12.5e3 \x00\x01", "a" * 300, "x  'r", "x 'll y'll'v've", "<|endoftext|", "x<|ENDOFTEXT|>"]


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice("aAbB  \n\t'''sretTlLvm09½²éÉΣσ漢🎉<|>endoftx ​́ !?.,#\x1c\x85") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_codec_is_the_library():
    library, own = Tokenizer.from_file(WORD_BPE), bpe_codec.PairIndexCodec(WORD_BPE)
    for text in ODD + random_texts(1500):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_counts_are_the_library():
    library, own = Tokenizer.from_file(BYTE_BPE), token_counts.TokenCounter(BYTE_BPE)
    texts = ODD + random_texts(1500)
    assert own.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_are_counted_whole(monkeypatch):
    own = token_counts.counter(BYTE_BPE)
    text = " ".join(random_texts(300)).replace("<|endoftext|>", "")
    whole = own.counts([text])
    monkeypatch.setattr(token_counts, "SCAN", 200)
    assert own.counts([text]) == whole


def test_scan_of_chunk_maps_is_the_serial_run():
    scanner = token_counts.BorderScanner()
    rng = np.random.default_rng(1)
    points = rng.choice(np.array([ord(c) for c in "ab're  \n9.'l"], np.uint32), 1000)
    state, marks = token_counts.FRESH, set()
    for i, c in enumerate(scanner.classes[points]):
        out = scanner.out[c, state]
        marks |= {i} if out & token_counts.HERE else set()
        marks |= {i - 1} if out & token_counts.BEFORE_LAST else set()
        state = scanner.next[c, state]
    assert set(scanner.borders(points).tolist()) == marks


def test_op2_and_op7_over_the_table(spark, small):
    word, byte = Tokenizer.from_file(WORD_BPE), Tokenizer.from_file(BYTE_BPE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op2_bpe_codec(spark, small).collect():
        ids = word.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in op7_token_counts(spark, small).collect():
        n = len(byte.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


ROWS = "doc_id long, text string, lang string, n_tokens string, score string"


@pytest.fixture
def odd_rows(spark):
    rows = [(1, None, None, "x", "y"), (None, "word " * 60, "en", "x", "y"), (2, "", "en", None, None), (2, "", "en", None, None), (3, "123 !!", "de", "", ""), (4, "the cat and the dog " * 4000, "en", "", "")]
    return spark.createDataFrame(rows, ROWS)


def test_odd_rows_have_defined_results(spark, odd_rows):
    got = bpe_codec.encode_documents(odd_rows, WORD_BPE).collect()
    assert len(got) == 6 and {r.doc_id: r.n_tokens for r in got}[1] == 0
    assert all(r.decoded == "" for r in got if r.n_tokens == 0)
    counts = token_counts.count_tokens(odd_rows, BYTE_BPE).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in counts)[:2] == [(0, 300), (1, 0)]
    for none in (bpe_codec.encode_documents(odd_rows.limit(0), WORD_BPE), token_counts.count_tokens(odd_rows.limit(0), BYTE_BPE), language_id.predict_languages(odd_rows.limit(0))):
        assert none.count() == 0


def test_languages_on_held_out_documents(spark, small):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op3_language_id(spark, small).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and sum(docs[r.doc_id] == r.lang_pred for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_languages_of_odd_rows(spark, odd_rows):
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict_languages(odd_rows).collect()}
    assert (1, "und") in got and (2, "und") in got and (3, "und") in got
    kept = language_id.drop_undetermined(odd_rows.withColumns({"__score": F.lit("own"), "__lang_pred": F.lit(1)}))
    assert kept.where("__score = 'own' AND __lang_pred = 1").count() == kept.count() > 0
    kept = kept.drop("__score", "__lang_pred")
    assert kept.columns == odd_rows.columns and {r.doc_id for r in kept.collect()} <= {None, 4}


def plain_backoff(learned, texts):
    """Language of each text by the definition: counts of words and n-grams of the learned (lang, text) rows, in plain Python."""
    import math
    from collections import Counter, defaultdict

    letters = re.compile(r"[^\W\d_]+")
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for lang, text in learned:
        words[lang].update(letters.findall((text or "").lower()))
    for lang, own in words.items():
        for w, n in own.items():
            f = f"_{w}_"
            for k in range(1, 6):
                for i in range(len(f) - k + 1):
                    grams[lang][f[i : i + k]] += n
    langs = sorted(words)
    log = lambda counts, key: np.array([math.log((counts[l][key] + 0.1) / (sum(counts[l].values()) + 1)) for l in langs])

    def score(w):
        if any(w in words[l] for l in langs):
            return log(words, w)
        for k in range(5, 0, -1):
            f = f"_{w}_"
            known = [g for i in range(len(f) - k + 1) if any((g := f[i : i + k]) in grams[l] for l in langs)]
            if known:
                return np.mean([log(grams, g) for g in known], axis=0)
        return np.zeros(len(langs))

    out = []
    for t in texts:
        found = letters.findall((t or "").lower())
        total = sum((score(w) for w in found), np.zeros(len(langs)))
        out.append((langs[int(np.argmax(total))], float(1 / np.exp(total - total.max()).sum())) if found else ("und", 0.0))
    return out


@pytest.mark.parametrize("block", [1_000_000, 50])
def test_backoff_by_brute_force(spark, monkeypatch, block):
    """Known words, unseen ones at every level of n-grams, texts without letters, and a cache that is cleared all the time."""
    import zlib

    monkeypatch.setattr(language_id, "blocks", lambda text: _blocks(text, block))
    rng = random.Random(4)
    syllables = {"aa": ["ka", "lo", "mi", "né"], "bb": ["ka", "tu", "re", "öx"], "cc": ["zi", "qu", "lo", "漢"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(150):
        lang = rng.choice(["aa", "bb", "cc"])
        rows.append((i, " ".join(word(lang) for _ in range(rng.randint(0, 12))) + rng.choice(["", " 12!", " zzzz", " q" * 60]), lang if i % 7 else None))
    rows += [(200, None, "aa"), (201, "wwww", "bb"), (202, "k" * 100, None)]
    learned = [(lang, t) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    want = plain_backoff(learned, [t for _, t, _ in rows])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[i][1] == pytest.approx(score, abs=1e-3) and (got[i][0] == lang or score < 0.51)
    assert len({w[0] for w in want}) == 4


_blocks = language_id.blocks


def test_quality_counts_by_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "a b a b a b", "x\ny\nx\n \n\nx"] + [" ".join(rng.choice("abc#") for _ in range(rng.randint(0, 80))) + "\n" * rng.randint(0, 3) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "z") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words string")
    for r in quality_rules.document_features(docs).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        rep = {j for i, x in enumerate(win) if win.count(x) > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(rep), len(lines) - len(set(lines)))


def test_binomial_tail_and_safe_cutoffs(spark):
    from math import comb

    n, k, a = 200, 3, 0.02
    got = spark.range(1).select(quality_rules.binomial_tail(quality_rules.F.lit(n).cast("long"), quality_rules.F.lit(k).cast("long"), a).alias("p")).first().p
    assert got == pytest.approx(sum(comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1)))
    good = [(i, "clean words here " * 20 + f"{i}", "en") for i in range(900)]
    bad = [(1000 + i, "bad### words*** " * 40, "en") for i in range(10)]
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i, _, _ in good] + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(1000, 0, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge_quality(docs, labels).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in bad)
    alone = {r.doc_id: (r.kept, r.base_failed) for r in quality_rules.judge_quality(docs, labels.limit(0)).collect()}
    assert all(kept != failed for kept, failed in alone.values())


def test_sql_of_the_native_operators(spark, small, oracle):
    from collections import Counter

    from folioflow.llm.queries import ORACLE_SQL

    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    for query in (op6_decontamination, op8_url_filter, op10_quality_rules):
        df = query(spark, small)
        cols = sorted(df.columns)
        rel = oracle.execute(ORACLE_SQL[query.__name__])
        names = [d[0] for d in rel.description]
        want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
        assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com", "http://example.com/en/x?y#z", "https://www.example.com/en/", "http://a.b.net/fr/", "http://net/fr/x", "http://xnet/fr/", "ftp://u@example.org/en/", "http://example.com/en", "http://example.com?/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(4, urls[4], "h")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()}
    assert got[0] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "", None, "allow")
    assert got[4] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[5][2:] == ("www.example.com/en/", "allow") and got[6][2:] == ("net/fr/", "block") and got[7][2:] == ("net/fr/", "block")
    assert got[8][2] is None and got[10][2] == "com/" and got[11] == ("example.com", "", None, "allow")
    assert url_filter.judge_urls(pages, url_filter.rule_table(spark)).count() == len(urls) + 1
    assert url_filter.judge_urls(pages, url_filter.rule_table(spark).limit(0)).where("verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_model_holds_grams_of_every_size(spark):
    docs = spark.createDataFrame([(i, "abcdef " * 5, "en") for i in range(40)], "doc_id long, text string, lang string")
    langs, words, grams = language_id.fit(docs)
    assert langs == ["en"] and (words.find(language_id._hashes(["abcdef", "abcde"])) >= 0).tolist() == [True, False]
    assert (grams.find(language_id._hashes(["a", "_a", "abc", "bcde", "_abcd", "cdef_", "abcdef"])) >= 0).tolist() == [True] * 6 + [False]
