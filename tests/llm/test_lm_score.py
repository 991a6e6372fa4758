from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np

from lectern.llm import common, lm_score
from tests.llm.conftest import ODD, frame, texts_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def vocabulary():
    return lm_score.pieces(common.tokenizer_path(lm_score.MODEL))


def test_lattice_is_the_sum_over_segmentations():
    import sentencepiece

    v = vocabulary()
    model = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(lm_score.MODEL))
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    row = {model.id_to_piece(i): r for r, i in enumerate(kept) if not model.is_byte(i)}

    def total(s: str, i: int = 0) -> float:
        if i == len(s):
            return 1.0
        ways = [math.exp(v.first[row[s[i:j]]]) * total(s, j) for j in range(i + 1, len(s) + 1) if s[i:j] in row]
        if s[i] not in row:
            ways.append(math.prod(math.exp(v.first[v.byte_id[b]]) for b in s[i].encode()) * total(s, i + 1))
        return sum(ways)

    words = ["the", "hello", "a", "naïve", "😀x", "zz", "", "thehethe", "中ﷺ"]
    lattice = lm_score.Lattice(v, words)
    got = lattice.forward(lattice.weights(v.first))[2]
    assert np.allclose(got, [math.log(total("▁" + w)) for w in words])


def test_expected_uses_are_the_gradient():
    v = vocabulary()
    words, n = ["hello", "the", "😀x", "thehethe"], np.array([1.0, 3.0, 2.0, 1.0])
    lattice = lm_score.Lattice(v, words)
    uses = lattice.expected(v.first, n)
    base = lattice.forward(lattice.weights(v.first))[2] @ n
    for piece in np.argsort(-uses)[:12]:
        moved = v.first.copy()
        moved[piece] += 1e-5
        assert abs((lattice.forward(lattice.weights(moved))[2] @ n - base) / 1e-5 - uses[piece]) < 1e-3


def check_base(df, head):
    texts = texts_of(df)
    count, ends = collections.Counter(), 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(WORD.findall((t or "").encode().lower()))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    rows = {r.doc_id: r for r in lm_score.score(df, df.where(~lm_score.held_out()), head=head).collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        words = WORD.findall((t or "").encode().lower())
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(count[w] for w in words), ends])
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(count[w] > 0 for w in words) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_base_score_and_counts(documents):
    check_base(documents, 500)


def test_odd_cases(spark, odd, none):
    check_base(odd, 0)
    check_base(odd, 100)
    assert lm_score.score(none, none).count() == 0
    rows = lm_score.score(odd.union(odd), none).collect()
    assert len(rows) == len(ODD) and {r.n_known for r in rows} == {0} and {r.train_tokens for r in rows} == {0}


def test_training_raises_the_likelihood(spark):
    df = frame(spark, ["zyx qwv zyx"] * 20)
    trained = lm_score.score(df, df).first().score
    assert trained > lm_score.score(df, df.limit(0)).first().score
