import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import op2_tokens as op2
from attestry.llm import op4_media as op4
from attestry.llm import op9_sentencepiece as op9
from tests.llm.conftest import ODD_TEXTS


@given(st.lists(st.integers(0, 2**32 - 1), max_size=700))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(ids):
    segment = op2.pack(np.array(ids, np.uint32))
    assert op2.unpack(segment).tolist() == ids
    assert op2.unpack(segment, 1, 3).tolist() == ids[128:384]


def test_outliers_are_exceptions():
    ids = np.full(1280, 7, np.uint32)
    ids[::100] = 4_000_000_000
    assert len(op2.pack(ids)) < 500
    with pytest.raises(ValueError):
        op2.unpack(b"nope" + bytes(20))


def test_tokens_as_the_library_has_them(spark, odd):
    encoder = op2.WordEncoder(op2.tokenizer_file())
    got = sorted(op2.read(op2.write(odd, op2.tokenizer_file(), segment_ids=3000)).collect(), key=lambda r: r["start"])
    texts = {i: t or "" for i, t in enumerate(ODD_TEXTS)} | {None: ODD_TEXTS[4]}
    at = 0
    for r in got:
        ids = [*encoder.tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, op2.END_ID]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == odd.count() and [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x))


@given(st.lists(st.sampled_from(["a", "The", "é", "'s", "don't", ".", "!?", "1", " ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "漢", "(", "_"]), max_size=25))
@settings(max_examples=150, deadline=None)
def test_words_as_texts(parts):
    encoder = op2.encoder_of(op2.tokenizer_file())
    text = "".join(parts)
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4")[:-1].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_each_distinct_word_is_looked_up_once(monkeypatch):
    """Lookups are by the distinct words of a slice, with marks apart, and not by its occurrences."""
    encoder, asked = op2.WordEncoder(op2.tokenizer_file()), []
    distinct = op2._distinct
    monkeypatch.setattr(op2, "_distinct", lambda *a: (out := distinct(*a), asked.extend(out[0]))[0])
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Owl", "owl", "owl,", "owl.", "tree", "tree!", "é,", "a.,", "sixteen_bytes_lg", "seventeen_bytes_l", "don't", "x\0", "x"]) for _ in range(500)) for _ in range(20)] + ["", " ", "a<", "|b <|EndOfText|> c,", "<|c,"]
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, op2.END_ID] for t in texts]
    asked.clear()
    got = encoder.encode([t.encode() for t in texts[:20]])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, op2.END_ID] for t in texts[:20]]
    assert len(asked) <= 14 and b"owl," not in asked


def test_long_words_are_not_kept():
    encoder = op2.WordEncoder(op2.tokenizer_file())
    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)) + k for k in ("", ".", "!?", " a")] * 3
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4")[:-1].tolist() for x in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(map(len, encoder.recent)) < 200 and max(map(len, encoder.recent)) <= op2.CACHED_BYTES


def test_tokens_of_nothing(none):
    assert op2.read(op2.write(none, op2.tokenizer_file())).count() == 0


def _payload(text):
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_media_come_back(spark, odd):
    store = op4.write(odd)
    got = op4.described(store).collect()
    texts = {i: t for i, t in enumerate(ODD_TEXTS)} | {None: ODD_TEXTS[4]}
    assert len(got) == odd.count()
    for r in got:
        p = _payload(texts[r["doc_id"]])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())
    assert len({r["media_sha256"] for r in got if texts[r["doc_id"]] == ODD_TEXTS[4]}) == 1
    shared = sum(len(bytes(r["data"])) for r in store.chunks.collect())
    assert 0 < shared < 30_000  # of 120,000 bytes; copies' chunks are there once
    stored = {hashlib.sha256(bytes(r["form"])).hexdigest(): len(bytes(r["form"])) for r in store.media.collect()}
    assert {r["media_sha256"]: r["media_bytes"] for r in got} == stored  # of the bytes that are stored
    bad = store._replace(chunks=store.chunks.selectExpr("digest", "cast(concat(cast(data as string), '!') as binary) AS data"))
    with pytest.raises(Exception, match="not what was stored"):
        op4.described(bad).collect()


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 255, 200_000).astype(np.uint8)
    longer = np.concatenate([rng.integers(0, 255, 777).astype(np.uint8), data])

    def names(x):
        ends = op4.cuts(op4.cut_candidates(x), 0, len(x))
        return {hashlib.sha256(x[a:b].tobytes()).digest() for a, b in zip([0, *ends], ends)}

    assert len(names(data) & names(longer)) > 0.8 * len(names(data))


def test_media_of_nothing(none):
    assert op4.described(op4.write(none)).count() == 0


def _best(pieces, text):
    """Viterbi over a whole table."""
    form, best, back = pieces.symbols(text), [0], [None]
    for end in range(1, len(text) + 1):
        options = [(best[s] + pieces.score[pieces.ids[form[s:end]]], -s, (pieces.ids[form[s:end]],)) for s in range(max(0, end - pieces.longest), end) if form[s:end] in pieces.ids]
        top = max(options, default=None)
        if top is None or end + top[1] > 1:
            raw = text[end - 1].encode()
            other = (best[end - 1] + pieces.byte_score * len(raw), 1 - end, tuple(pieces.byte_id[b] for b in raw))
            top = other if top is None or other[0] > top[0] else top
        best.append(top[0])
        back.append((-top[1], top[2]))
    out, at = [], len(text)
    while at:
        at, ids = back[at]
        out[:0] = ids
    return out


@given(st.lists(st.sampled_from(["the", "a", "ing", " ", "  ", "\n", "é", "▁", "\0", "漢", "😀", "xq", "tion", "1"]), max_size=40))
@settings(max_examples=80, deadline=None)
def test_stream_commits_the_best_path(parts):
    text, encoder = "".join(parts), op9.encoder_of(op9.model_file())
    want = _best(encoder.pieces, text)
    assert op9.stream_encode(encoder.pieces, text, 3) == want == encoder.encode(text).tolist()
    assert encoder.pieces.decode(want) == text


@pytest.mark.parametrize("kind", ["latin", "han", "pieces", "periodic", "unary", "odd"])
def test_long_runs_are_joined_from_windows(kind, monkeypatch):
    """Runs without spaces, committed in parts and in one, against the search over a whole table."""
    encoder, rng = op9.encoder_of(op9.model_file()), random.Random(7)
    pool = [p for p in encoder.pieces.ids if not p.startswith("▁") and len(p) > 1]
    text = {
        "latin": lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(4000)),
        "han": lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4000)),
        "pieces": lambda: "".join(rng.choice(pool) for _ in range(1000)),
        "periodic": lambda: "abcabcd" * 600,
        "unary": lambda: "=" * 4001,
        "odd": lambda: "".join(rng.choice(["▁", "\0", "😀", "é", "ing", "the", "=="]) for _ in range(3000)),
    }[kind]()
    want = np.array(_best(encoder.pieces, text), "<i4").tobytes()
    assert encoder.search.long(text) == want == op9.np.array(op9.stream_encode(encoder.pieces, text), "<i4").tobytes()
    monkeypatch.setattr(op9.Search, "CHUNK", 700)
    assert encoder.search.long(text) == want
    monkeypatch.setattr(op9.Search, "_joined", lambda *_: None)  # windows that never meet are left to the stream
    assert encoder.search.long(text) == want


def test_long_words_pass_the_cache():
    encoder = op9.Encoder(op9.model_file())
    encoder.encode_all(["x" * 5000 + " " + "word " * 40, "漢" * 9000])
    assert max(map(len, encoder.recent)) <= op9.CACHED_CHARS


def test_window_stays_small():
    pieces = op9.encoder_of(op9.model_file()).pieces
    stream = op9.Stream(pieces)
    for _ in range(400):
        stream.push("internationalization" * 5)
    assert stream.widest < 20 * pieces.longest
    assert pieces.decode(stream.finish()) == "internationalization" * 2000


def test_pieces_of_documents(odd, none):
    got = op9.decoded(op9.encoded(odd, op9.model_file()), op9.model_file()).collect()
    assert len(got) == odd.count() and all(r["round_trip"] for r in got)
    assert all(r["decoded"] == (ODD_TEXTS[4 if r["doc_id"] is None else r["doc_id"]] or "") for r in got)
    assert op9.encoded(none, op9.model_file()).count() == 0
