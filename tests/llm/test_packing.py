import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dialoglake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = ["", "  ", "It's THE end,. ok...  ", "a b c\tline\r\nnext", "ÀÉÎ ß ΣΑΣ İstanbul", "12345 $$$ ### don't we'll", "é Å ́x", "日本語 text 한국어", "\x1c\x1dab", "x" * 300, "word " * 5000]


def one_by_one(counts, capacity):
    """Best-fit decreasing, a piece at a time."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                fit = capacity
            else:
                rooms.remove(fit)
            rooms.append(fit - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 37, 100])
    counts = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
    runs, opened = packing.plan_best_fit(counts, cap)
    assert opened == one_by_one(counts, cap)
    taken = {}
    for i, (length, rank, per, first, offset) in enumerate(runs):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
        for r in range(end - rank):
            taken.setdefault(first + r // per, []).append((offset + r % per * length, length))
    assert sum(len(v) for v in taken.values()) == sum(counts.values())
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap


def test_token_bytes_equal_whole_text_encoding():
    tok = Tokenizer.from_file(PATH)
    for text, raw in zip(AWKWARD, packing.token_bytes(AWKWARD, PATH, 0)):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids + [0], text


def test_packs_every_token_once(spark):
    texts = [*AWKWARD, None, "same words here", "same words here"]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)] + [(5, "again the id 5", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    packed = packing.pack_documents(docs, PATH, capacity=64, keep_ids=True).cache()
    got = packed.collect()
    tok = Tokenizer.from_file(PATH)
    want = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids + [0]) for _, t, _ in rows)
    docs_seen = {}
    for r in got:
        assert r.length == len(r.ids) <= 64 and r.start == 64 * r.piece
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs_seen.setdefault(r.doc_id, []).append((r.piece, r.ids))
    assert sorted(i for v in docs_seen.values() for _, ids in v for i in ids) == sorted(i for w in want for i in w)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for s in packing.sequences(packed).collect():
        at = 0
        for r in sorted(by_seq[s.sequence_id], key=lambda r: r.offset):
            assert r.offset == at and s.ids[at : at + r.length] == r.ids
            at += r.length
        assert at == s.n_tokens <= 64


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).collect() == []


def test_special_tokens_in_any_case():
    """Only the exact form is one id, alone or inside a word; other cases are plain text."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    texts = [f"Some {x} More {x.upper()} {x.title()} in{x}side A{x.upper()}B {x}{x}\nEND {x[:-1]}" for x in special] + ["<|ENDOFTEXT|>", "x<|StartOfText|>y", "a <|ENDOFTEXT|> b", "<|endoftext|>", "no mark < | here"]
    for text, raw in zip(texts, packing.token_bytes(texts, path, 0)):
        assert np.frombuffer(raw, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], text


def test_new_words_are_encoded_many_at_once(monkeypatch):
    whole, given = Tokenizer.from_file(PATH), []

    class Counting:
        get_added_tokens_decoder = whole.get_added_tokens_decoder

        def encode_batch_fast(self, texts, add_special_tokens):
            given.extend(texts)
            return whole.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    monkeypatch.setattr(packing, "_worker", {"tokenizer": Counting()})
    texts = [" ".join(f"{'abcdefghij'[k % 10]}word{k}!" for k in range(i, i + 600)) for i in (0, 300, 900)]
    for text, raw in zip(texts, packing.token_bytes(texts, PATH, 0)):
        assert np.frombuffer(raw, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]
    assert len(given) < 10
    # Words that hold the mark itself are taken one by one.
    texts = ["a\x01b \x01 c\x01", "\x01", "\u0301x e\u0301 \u0301", "tab\tin \u00a0 side"]
    for text, raw in zip(texts, packing.token_bytes(texts, PATH, 0)):
        assert np.frombuffer(raw, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], text
