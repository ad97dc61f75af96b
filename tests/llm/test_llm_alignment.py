"""Cross-tokenizer alignment against plain Python."""

from __future__ import annotations

import hashlib
import random
import unicodedata
from collections import Counter

import pytest

from tapeflow.llm import alignment as A
from tapeflow.llm.common import ship_code
from tapeflow.llm.packing import tokenizer_path

RNG = random.Random(8)
ODD = ["▁", " ", "\x85", "\x00", "﻿", "　", "é", "é", "ß", "語", "😀", "👩‍👩‍👧",
       "\n", "\t", "  ", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "can't", "12", "½", "a"]
TEXTS = [None, "", " ", "   ", "\n", "a", "Hello world, hello  world!", "▁", "a▁b", "<s> <0x41>",
         "<|endoftext|> end", "über Straße 1234567 déjà-vu", "語言 😀 mixed", "x" * 3000,
         "word " * 4000, "﻿bom", "tail space ", " lead", "a\x00b", "́combining"] + [
         "".join(RNG.choice(ODD) + RNG.choice(["", " "]) for _ in range(RNG.randint(1, 30)))
         for _ in range(60)]


def brute(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer_path(A.BYTE_LEVEL))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_path(A.PIECES))
    back = {c: i for i, c in A._byte_letters().items()}
    out, corpus = [], Counter()
    for t in texts:
        none = ([], [], [], [])
        if not t:
            out.append(none)
            continue
        raw = b" " + t.encode()
        ia = a.encode(" " + t, add_special_tokens=False).ids
        ib = b.encode(t)
        ba = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
              else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ba) != raw or b"".join(bb) != raw:
            out.append(none)
            continue
        links, groups, ga, gb = [], [], [], []
        i = j = pa = pb = 0
        while i < len(ia) or j < len(ib):
            links.append((ia[i], ib[j]))
            ea, eb = pa + len(ba[i]), pb + len(bb[j])
            if ea <= eb:
                ga.append(ia[i])
            if eb <= ea:
                gb.append(ib[j])
            if ea <= eb:
                i, pa = i + 1, ea
            if eb <= ea:
                j, pb = j + 1, eb
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
        out.append((ia, ib, groups, links))
        corpus.update(links)
    best = Counter()
    for (_, y), n in corpus.items():
        best[y] = max(best[y], n)
    rows = []
    for ia, ib, groups, links in out:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(ia), len(ib), len(groups), len(links),
                     sum(corpus[p] == best[p[1]] for p in links), sum(corpus[p] for p in links),
                     hashlib.sha256(text.encode()).hexdigest() if ia else ""))
    return rows


@pytest.mark.parametrize("pairs, part", [(A.BROADCAST_PAIRS, A.PART_BYTES), (0, 64)])
def test_alignment_equals_brute_force(spark, monkeypatch, pairs, part):
    ship_code(spark)
    monkeypatch.setattr(A, "BROADCAST_PAIRS", pairs)  # 0: the shuffled join
    monkeypatch.setattr(A, "PART_BYTES", part)
    texts = [*TEXTS, TEXTS[6]]
    rows = [(i if i else None, t, 1, 2) for i, t in enumerate(texts)]
    rows[-1] = (6, texts[-1], 1, 2)  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair long, row long")
    got = sorted(map(str, (tuple(r) for r in A.alignment_report(docs.repartition(3)).collect())))
    want = sorted(str((r[0], *w)) for r, w in zip(rows, brute(texts), strict=True))
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.alignment_report(docs).count() == 0


def test_both_libraries_class_latin_letters_alike():
    side, _ = A.sides()
    texts = []
    for c in map(chr, range(0x250)):
        texts += [f"a{c}b {c}{c} {c}1 1{c} .{c}. x {c}", f"{c}", f"  {c}  {c}\n{c}'s"]
    slow = [e.ids for e in side.whole.encode_batch([" " + t for t in texts],
                                                   add_special_tokens=False)]
    assert side.ids(texts) == slow
    assert unicodedata.category("ɏ")[0] == "L"
