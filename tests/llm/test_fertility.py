import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from verdara.llm import fertility
from verdara.llm.vocab import BYTE_RANKS, PIECES, Store, WordTokens, file_bytes, read_ranks
from verdara.sources.scratch import stored


@pytest.fixture(scope="module")
def tokens():
    return WordTokens((file_bytes(None, BYTE_RANKS), file_bytes(None, PIECES)))


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def test_base_counts_match_brute_force(tokens, edge_rows):
    texts = [t or "" for _, t, _ in edge_rows] + [
        "a b c a b c d", "a\na\n\nb\n a\na", "## <b> || a*b", "a b c d a b c"]
    for t in texts:
        assert fertility.text_measures(t, tokens)[:5] == brute_base(t)


def test_tokens_of_words_match_the_libraries(tokens):
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN,
                            mergeable_ranks=read_ranks(file_bytes(None, BYTE_RANKS)),
                            special_tokens={})
    words = ["plain", "Ünï", "日本語", "don't", "😀", "x" * 300, "a b", "▁odd", "ﬁne", "𓀀ᚠ"]
    ids = [i for w in words for i in enc.encode_ordinary(" " + w)]
    share = np.array(list(Counter(ids).values())) / len(ids)
    n, entropy, n_pieces, n_bytes = tokens.stats([w.encode() for w in words])
    assert n == len(ids) and entropy == pytest.approx(-(share * np.log2(share)).sum())
    single = [tokens.pieces.encode(w) for w in words]
    assert n_pieces == sum(map(len, single))
    assert n_bytes == sum(tokens.pieces.is_byte(i) for s in single for i in s) > 0


def test_store_stays_bounded_and_right():
    store = Store(lambda ks: [k * 2 for k in ks], limit=10)
    for at in range(0, 200, 3):
        store.ready(range(at, at + 6))
        assert [store[k] for k in range(at, at + 6)] == [2 * k for k in range(at, at + 6)]
        assert len(store) <= 16


def test_store_takes_more_keys_than_its_limit_in_one_call():
    asked = []
    store = Store(lambda ks: asked.append(len(ks)) or [k * 2 for k in ks], limit=10)
    for keys in (range(5), range(3, 48), range(40, 75), range(6)):
        store.ready(keys)
        assert [store[k] for k in keys] == [2 * k for k in keys]
    assert max(asked) <= 10 and len(store) + len(store.old) <= 10


def test_text_with_more_words_than_the_store_holds(tokens, monkeypatch):
    words = [f"w{i}".encode() for i in range(500)]
    want = tokens.stats(words)
    monkeypatch.setattr(tokens, "words", Store(tokens._make, limit=100))
    assert tokens.stats(words) == want


def test_word_of_a_million_odd_blanks(tokens):
    """The library's own search for pieces runs out of stack on it."""
    n, entropy, n_pieces, n_bytes = tokens.stats(["\u00a0".encode() * 1_000_000, b"end"])
    assert n == 2_000_001 and n_bytes == 0 < n_pieces and entropy == pytest.approx(1.0, abs=1e-4)
    few = "\u00a0" * 5000
    assert tokens.stats([few.encode()])[0] == len(tokens.encoder.encode_ordinary(" " + few))


def test_texts_without_words_beside_a_band(spark):
    """They have no tokens; judging them must not divide by that number."""
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefghilmnoprst"), rng.integers(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(20)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(20, None, "en"), (21, "", "en"), (22, " \n\t ", "de"), (23, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    measured = stored(fertility.measure(docs).drop("text"))
    judged = fertility.judge(measured, fertility.fit_bands(measured))
    found = {r["doc_id"]: r for r in judged.collect()}
    assert len(found) == 24 and sum(r["kept"] for r in found.values()) >= 18
    assert all(found[i]["base_failed"] and found[i]["n_tokens"] == 0 and not found[i]["kept"]
               for i in range(20, 24))
    assert {(r["kept"], r["base_failed"]): r["count"]
            for r in judged.where("n_tokens = 0").groupBy("kept", "base_failed").count().collect()
            } == {(False, True): 4}


def test_rejects_junk_and_keeps_clean(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghilmnoprst"), rng.integers(2, 8))) for _ in range(400)]
    clean = [" ".join(rng.choice(vocabulary, 150)) for _ in range(300)]
    junk = [" ".join(f"{rng.integers(1 << 60):016x}###" for _ in range(150)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)],
                                 "doc_id long, text string, lang string")
    measured = fertility.measure(docs).cache()
    kept = {r["doc_id"]: r["kept"] for r in fertility.judge(measured, fertility.fit_bands(measured)).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 305))


def test_copies_do_not_narrow_a_band_to_nothing(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghilmnoprst"), rng.integers(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(16)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts[:1] * 60 + texts[1:])],
                                 "doc_id long, text string, lang string")
    measured = fertility.measure(docs).cache()
    judged = fertility.judge(measured, fertility.fit_bands(measured)).collect()
    assert all(r["kept"] for r in judged if r["doc_id"] < 60) and sum(r["kept"] for r in judged) >= 70


def test_edge_cases(edge_docs, no_docs):
    measured = fertility.measure(edge_docs).cache()
    rows = fertility.judge(measured, fertility.fit_bands(measured)).collect()
    assert len(rows) == 13 and all(r["kept"] in (True, False) for r in rows)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert all(r["base_failed"] and r["n_tokens"] == 0 for r in rows if not (r["text"] or "").strip())
    empty = fertility.measure(no_docs)
    assert fertility.judge(empty, fertility.fit_bands(empty)).collect() == []
