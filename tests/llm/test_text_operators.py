"""Sentence pieces, fill-in-middle texts and ranked search against plain versions and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from comparing import difference, duck

from lingospan.llm import fill_in_middle, ranked_search, sentence_pieces
from lingospan.llm.queries import ORACLES, QUERIES, tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, ids array<int>, form string, output string, n long, item long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def awkward_texts():
    rng = random.Random(5)
    signs = [*"abcdeAB  \n\t.,<>PSM'-", "é", "ñ", "日", "本", "語", "😀", "▁", "́", " ", "​", "\x00", "\x7f", "ﬁ", "①", "Ａ", "ガ", "ｶ", "ﾞ"]
    texts = [None, "", " ", "   ", "\n", "a", "▁", " ▁ ", "<P>", "x<M>y", "<", "<P", "P>", "😀😀", "trail  ", "  lead", "a  b", "the the the"]
    return texts + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(150)]


def awkward_rows():
    texts = awkward_texts()
    rows = [(i, t, [1], "plain", "x", 7, 8) for i, t in enumerate(texts)]
    return [*rows, rows[20], (3, "another text", None, None, None, None, None), (None, texts[30], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ---- sentence pieces


def field(number, value):
    """One field of a protocol buffer message."""

    def varint(x):
        out = bytearray()
        while x > 0x7F:
            out.append(x & 0x7F | 0x80)
            x >>= 7
        return bytes([*out, x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def built_model(fallback: bool, trim: bool, prefix: bool, rules: str | None, symbols=(), n=3000) -> bytes:
    """A model with the first pieces of the given one and other rules; nothing is trained."""
    given = sentence_pieces.Model.at(MODEL)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(s, 0.0, 4) for s in symbols]
    normal = [(t, s) for t, s, k in zip(given.texts, given.scores, given.kinds, strict=True) if k == 1 and t not in symbols]
    singles = [x for x in normal if len(x[0]) == 1 and ord(x[0]) < 0x250 or x[0] == "▁"]
    pieces += [(t, s, 1) for t, s in [*normal[:n], *(x for x in singles if x not in normal[:n])]]
    data = b"".join(field(1, field(1, t.encode()) + field(2, s) + field(3, k)) for t, s, k in pieces)
    data += field(2, field(3, 2) + field(35, int(fallback)))
    spec = field(3, int(prefix)) + field(4, int(trim)) + field(5, 1)
    if rules:
        whole = sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto()
        normalizer = dict(sentence_pieces._fields(dict(sentence_pieces._fields(whole))[3]))
        spec = field(1, b"own") + field(2, normalizer[2]) + spec
    return data + field(3, spec)


def same_as_library(data: bytes, texts) -> None:
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = sentence_pieces.Model(data)
    encoder, decoder = sentence_pieces.Encoder(model), sentence_pieces.Decoder(model)
    for part in (texts, texts[::-1]):
        ids, low, high, borders = encoder(pa.array(part, pa.string()))
        out, ends = decoder(ids.astype(np.int64), borders)
        ends = [0, *ends]
        for i, text in enumerate(part):
            a, b = borders[i], borders[i + 1]
            pieces = library.encode(text or "", return_type="proto").pieces
            assert ids[a:b].tolist() == [p.id for p in pieces], text
            assert list(zip(low[a:b], high[a:b], strict=True)) == [(p.begin, p.end) for p in pieces], text
            assert bytes(out[ends[i] : ends[i + 1]]).decode() == library.decode([p.id for p in pieces]), text


def test_pieces_places_and_texts_as_the_library():
    with open(MODEL, "rb") as file:
        same_as_library(file.read(), awkward_texts())


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize(("prefix", "rules", "symbols"), [(True, "nmt_nfkc", ()), (False, None, ()), (True, "nfkc_cf", ("<sep>", "ガ", "ab", "a")), (False, "nmt_nfkc", ("本語", "the"))])
def test_other_models_as_the_library(fallback, trim, prefix, rules, symbols):
    texts = awkward_texts() + ["a<sep>b<sep>", "日本語 the the", "ﬁﬁ  ①② ｶﾞ ｶ", "  a　b  ", "Ａ é é"]
    same_as_library(built_model(fallback, trim, prefix, rules, symbols), texts)


def test_long_runs_are_merged_as_the_library():
    texts = ["a" * 20_000, "xy" * 5_000 + " " + "日本語" * 3_000, " " * 3_000 + "end", "the" * 400]
    with open(MODEL, "rb") as file:
        same_as_library(file.read(), texts)


def test_any_ids_decode_as_the_library():
    rng = random.Random(2)
    for data in (open(MODEL, "rb").read(), built_model(True, True, True, "nmt_nfkc")):
        library = sentencepiece.SentencePieceProcessor(model_proto=data)
        decoder = sentence_pieces.Decoder(sentence_pieces.Model(data))
        mark, n = library.piece_to_id("▁"), library.vocab_size()
        for _ in range(500):
            ids = [rng.choice([0, 1, 2, mark, mark, rng.randrange(3, 259), rng.randrange(259, n)]) for _ in range(rng.randrange(0, 10))]
            out, _ = decoder(np.array(ids, np.int64), np.array([0, len(ids)]))
            assert bytes(out).decode() == library.decode(ids), ids


def test_other_kinds_of_models_are_refused():
    unigram = field(1, field(1, b"<unk>") + field(3, 2)) + field(2, field(3, 1))
    with pytest.raises(ValueError):
        sentence_pieces.Model(unigram)


def test_encoded_rows(spark, docs, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = []
    for row in awkward_rows():
        ids = library.encode(row[1] or "")
        expected.append((row[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = sentence_pieces.digest(sentence_pieces.encoded(docs, MODEL), MODEL).collect()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in got)
    assert sentence_pieces.digest(sentence_pieces.encoded(nothing, MODEL), MODEL).count() == 0
    back = sentence_pieces.decoded(spark.createDataFrame([(1, None), (2, []), (3, library.encode("x y"))], "n long, ids array<int>"), MODEL)
    assert [r["decoded"] for r in back.orderBy("n").collect()] == ["", "", "x y"]


def test_words_forgotten_between_batches(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "KEPT_WORDS", 50)
    with open(MODEL, "rb") as file:
        same_as_library(file.read(), awkward_texts()[10:80])


# ---- fill-in-middle


def plain_fim(doc_id, text, seed=1):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, key = len(tokens), "" if doc_id is None else doc_id
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h[3] % 100 < 20:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text)


def test_fill_in_middle(docs, nothing):
    got = fill_in_middle.digest(fill_in_middle.restored(fill_in_middle.transformed(docs))).collect()
    expected = [plain_fim(r[0], r[1]) for r in awkward_rows()]
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.digest(fill_in_middle.restored(fill_in_middle.transformed(nothing))).count() == 0


def test_fill_in_middle_long_texts(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab é日\n") for _ in range(300_000))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_in_middle.digest(fill_in_middle.restored(fill_in_middle.transformed(docs, seed=9))).collect()
    assert sorted(repr(plain_fim(*r, seed=9)) for r in rows) == sorted(repr(tuple(r)) for r in got)


def test_rotation_in_place(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "SWAP", 3)
    for n in range(12):
        for m in range(n + 1):
            data = bytearray(b"__" + bytes(range(65, 65 + n)) + b"__")
            fill_in_middle.rotate(np.frombuffer(data, np.uint8), 2, 2 + m, 2 + n)
            whole = bytes(range(65, 65 + n))
            assert bytes(data) == b"__" + whole[m:] + whole[:m] + b"__"


# ---- ranked search


def plain_search(docs, items, k):
    split = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def folded(text):
        return split.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    counts = [(doc_id, Counter(folded(text))) for doc_id, text in docs]
    counts = [c for c in counts if c[1]]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in counts:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = 0
            for t in set(folded(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id if doc_id is not None else 0))
        for rank, (score, unknown, doc_id) in enumerate(sorted(scores)[:k], 1):
            out.append((item_id, rank, None if unknown else doc_id, -score))
    return sorted(map(repr, out))


def searchable():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "ÀB", "Z9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(1, 120))) + rng.choice(["", ".", "\n\t"]) for _ in range(250)]
    docs = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    copies = [(2000 - i, texts[3] if i % 2 else texts[9]) for i in range(120)]
    docs += [*copies, (5000, None), (5001, ""), (5002, "... \n"), (docs[0][0], texts[5]), (None, texts[3]), (None, texts[7])]
    items = [(i, " ".join(rng.sample(words, rng.randrange(1, 25)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "unheard of"), (33, texts[3]), (33, texts[9]), (None, "W1 w2 W1"), (34, "日本 É é")]
    return docs, items


@pytest.mark.parametrize(("leaf", "wave", "block"), [(512, 128, 16 << 20), (1, 1, 16 << 20), (8, 3, 4000), (0, 64, 1)])
def test_search_in_blocks_of_a_task(monkeypatch, leaf, wave, block):
    """Everything from postings to lists in one process, over intervals and blocks of all sizes."""
    docs, items = searchable()
    wanted = [set(ranked_search.terms((t or "").encode())) for _, t in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    wanted = [np.array(sorted(vocabulary[t] for t in w), np.int64) for w in wanted]
    monkeypatch.setattr(ranked_search, "BLOCK_TEXT", block)

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(ranked_search, "TaskContext", Task)
    batches = [pa.record_batch([pa.array([d[0] for d in docs[i : i + 40]], pa.int64()), pa.array([d[1] for d in docs[i : i + 40]])], ["doc_id", "text"]) for i in range(0, len(docs), 40)]
    rows = [r for b in ranked_search._postings(vocabulary)(batches) for r in b.to_pylist()]
    n_docs, n_terms = sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows)
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        df[r["terms"]] += r["counts"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df])
    got = []
    for (item_id, _), w in zip(items, wanted, strict=True):
        top = ranked_search.TopList(10)
        for r in rows:
            ranked_search.best_first(ranked_search.Block(r, weights, n_docs, n_terms), w, top, leaf, wave)
        for rank, (doc_id, score) in enumerate(zip(top.ids.tolist(), top.scores.tolist(), strict=True), 1):
            got.append((item_id, rank, None if doc_id == ranked_search.NO_ID else doc_id, score))
    assert sorted(map(repr, got)) == plain_search(docs, items, 10)


@pytest.mark.parametrize("item_text", [4_000_000, 60])
def test_search(spark, monkeypatch, item_text):
    monkeypatch.setattr(ranked_search, "ITEM_TEXT", item_text)
    docs, items = searchable()
    items = items if item_text > 1000 else items[-8:]
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item long, item_id string").repartition(4)
    wanted = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, item long")
    got = [repr(tuple(r)) for r in ranked_search.searched(table, wanted).collect()]
    assert sorted(got) == plain_search(docs, items, 10)


def test_search_without_documents_or_items(spark, nothing):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.searched(nothing, items).count() == 0
    assert ranked_search.searched(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.where("false")).count() == 0


def test_intervals_are_bounded_away():
    """Few documents are scored when the best ones stand out."""
    n = 20_000
    impact_docs = np.arange(n)
    tf = np.where(impact_docs % 2000 == 7, 50, 1).astype(np.int32)
    row = {"doc_ids": impact_docs.astype(np.int64).tobytes(), "lengths": np.full(n, 100).tobytes(), "terms": [0], "counts": [n], "docs": impact_docs.astype(np.int32).tobytes(), "occurrences": tf.tobytes()}
    block = ranked_search.Block(row, np.array([500]), n, 100 * n)
    top = ranked_search.TopList(10)
    assert ranked_search.best_first(block, np.array([0]), top, leaf=8) < n // 20
    assert sorted(top.ids.tolist()) == list(range(7, n, 2000))


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_ranked_search"])
def test_query_matches_its_sql(spark, data_dir, name):
    assert difference(QUERIES[name](spark, data_dir), duck(data_dir), ORACLES[name]) is None


def test_sentence_pieces_of_all_documents(spark, data_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for doc_id, text in texts:
        ids = library.encode(text or "")
        expected[doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_sentence_pieces"](spark, data_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == expected
