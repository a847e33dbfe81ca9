"""Alignment of two tokenizers against a plain version."""

import hashlib
import json
import pathlib
import random
from collections import Counter

import pytest

from twinline.llm import align as al
from twinline.llm.bpe import byte_letters
from twinline.llm.queries import piece_path, tokenizer_path

TEXTS = [
    None, "", " ", "  two  blanks ", "Plain words, and punctuation!", "tabs\tand\nlines\r\n", "Größe façade naïve", "漢字かな交じり文 🙂👍🏽",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a lower one eighth block ▁ stands here", "x" * 3000, "internationalization unbelievably " * 200,
    "0123456789 3.14159", "Plain words, and punctuation!", "​﻿ é", "nul \x00 byte", "क्ष กำ",
]


def plain(texts):
    """Rows without counts of the corpus, and each text's links as pairs of ids."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(tokenizer_path()), SentencePieceProcessor(model_file=piece_path())
    first.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    rows, links = [], []
    for text in texts:
        text = text or ""
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        in_a = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
        in_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for tokens in (in_a, in_b):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        links.append([(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e])
        common = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, own, other = [], [], []
        for end in sorted(common):
            in_group = [[i for i, (_, e) in zip(ids, side) if start < e <= end] for ids, side, start in ((a, spans[0], max([0, *(c for c in common if c < end)])), (b, spans[1], max([0, *(c for c in common if c < end)])))]
            groups.append("|".join(",".join(map(str, g)) for g in in_group))
        rows.append((len(a), len(b), len(groups), len(links[-1]), ";".join(groups)))
    return rows, links


def with_counts(texts):
    rows, links = plain(texts)
    counts = Counter(pair for own in links for pair in set(own))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    return [(*row, sum(counts[p] == top[p[0]] for p in own), sum(counts[p] for p in own)) for row, own in zip(rows, links)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


@pytest.mark.parametrize("most", [al.BROADCAST_PAIRS, 0])
def test_against_a_plain_version(docs_of, most):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in al.align(docs_of(TEXTS), tokenizer_path(), piece_path(), broadcast_pairs=most).collect()}
    want = with_counts(TEXTS)
    for i, row in enumerate(want):
        assert got[i] == row, TEXTS[i]
    assert want[0] == want[1] == want[9] == (0, 0, 0, 0, "", 0, 0)  # null, empty, and a text that B doesn't give back
    assert any("," in g.split("|")[0] and "," in g.split("|")[1] for row in want for g in row[4].split(";") if g)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60)
    texts = [r.text if len(r.text or "") < 4000 else None for r in docs.collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(al.align(df, tokenizer_path(), piece_path()).collect(), key=lambda r: r.doc_id)
    assert [tuple(r[c] for c in COLUMNS) for r in got] == with_counts(texts)


def test_the_quicker_library_gives_the_same_ids():
    known = al.vocabularies(tokenizer_path(), piece_path())
    assert known.ranks and len(known.ranks) == 50256
    quick, usual = al.byte_level_encoder(known), al.byte_level_encoder(known._replace(ranks=None))
    rng = random.Random(2)
    texts = [t for t in TEXTS if t] + [f" a{c}b 1{c}2 {c} {c}{c}!{c} x" for c in map(chr, rng.sample(range(1, 0xD800), 3000))]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz'  \n0123.", k=rng.randint(1, 300))) for _ in range(500)]
    texts += [b"".join(rng.choices(known.a, k=12)).decode("utf-8", "ignore") for _ in range(2000)]
    assert quick(texts) == usual(texts)


def test_a_file_of_another_kind_is_run_as_it_is(tmp_path, docs_of):
    data = json.loads(pathlib.Path(tokenizer_path()).read_text("utf-8"))
    data["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(data))
    assert al.vocabularies(str(other), piece_path()).ranks is None
    rows = {r.doc_id: r.n_a for r in al.align(docs_of(TEXTS), str(other), piece_path()).collect()}
    assert rows[4] > 0


def test_tasks_that_count_in_turns(docs_of, monkeypatch):
    known = al.vocabularies(tokenizer_path(), piece_path())
    ids = al.token_ids(docs_of(TEXTS, 2).select("doc_id", "text"), known)
    whole = sorted(al.pair_counts(ids, known).collect())
    monkeypatch.setattr(al, "COUNTED_PAIRS", 3)
    assert sorted(al.pair_counts(ids, known).collect()) == whole


def test_ids_and_odd_tables(spark):
    rows = [(None, "same text", 1), (4, "same text", 2), (4, "same text", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long")
    got = al.align(df, tokenizer_path(), piece_path()).collect()
    assert sorted((r.doc_id for r in got), key=str) == [4, 4, None]
    assert all(r.count_sum == 3 * r.n_links and r.n_best == r.n_links > 0 for r in got)
    empty = al.align(df.limit(0), tokenizer_path(), piece_path())
    assert empty.count() == 0 and set(empty.columns) == {"doc_id", *COLUMNS}
    assert al.align(df.limit(0), tokenizer_path(), piece_path(), broadcast_pairs=-1).count() == 0


def test_query_gives_digests(spark):
    from twinline.llm.queries import op13_cross_tokenizer_alignment

    rows = op13_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001").limit(3)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert all(len(r.groups_sha256) == 64 for r in rows.collect()) and len(hashlib.sha256(b"").hexdigest()) == 64
