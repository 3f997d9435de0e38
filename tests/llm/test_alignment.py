"""Token alignment against a plain version over byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from protosift.llm.queries import op12_token_alignment, vocabulary
from protosift.llm.token_alignment import ByteLevel, Pieces, Rows, TokenAligner, _byte_names

TEXTS = [
    "The quick brown fox, can't jump  over 12345 dogs.\n\n\tNew line  ",
    "", None, " ", "a", "  two  spaces", "naïve café 東京タワー 🙂 <|endoftext|> and </s> <s>",
    "x\x1fy\x85z ​ a b", "▁literal mark", "ﬁ ligature Å Å", "\x00 nul", "The quick brown fox" * 400,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "The quick brown fox, can't", "The quick brown fox, can't", "É" * 3000,
    "  lead", "trail  ", "…–—“”", "it's I'LL we're 'S",
]


def plain(texts):
    """Per text the contract's numbers, from byte ranges of tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    names = {c: b for b, c in _byte_names().items()}
    encoded, pairs = [], Counter()
    for text in texts:
        if not text:
            encoded.append(None)
            continue
        first = one.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(names[c] for c in t)) for i, t in zip(first.ids, first.tokens)]
        b = []
        for i in two.encode(text):
            p = two.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            encoded.append(None)
            continue

        def ranges(side):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        ra, rb = ranges(a), ranges(b)
        links = [(x[0], y[0]) for x in ra for y in rb if x[1] < y[2] and y[1] < x[2]] if len(ra) < 2000 else None
        if links is None:
            links, j = [], 0
            for x in ra:
                while rb[j][2] <= x[1]:
                    j += 1
                k = j
                while k < len(rb) and rb[k][1] < x[2]:
                    links.append((x[0], rb[k][0]))
                    k += 1
        cuts = sorted({x[2] for x in ra} & {x[2] for x in rb})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x[0]) for x in side if start < x[2] <= cut) for side in (ra, rb)))
            start = cut
        pairs.update(links)
        encoded.append((len(ra), len(rb), len(cuts), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    out = []
    for e in encoded:
        if e is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, cuts, links, groups = e
        out.append((
            a, b, cuts, len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links),
            hashlib.sha256(groups.encode()).hexdigest(),
        ))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("align"))
    rows = [Row(doc_id=i if i != 5 else None, text=t, n_a="clash") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("frequent", [1 << 20, 40, 1])
def test_query_equals_plain_version(spark, documents, monkeypatch, frequent):
    """Whether all pairs, some or none are frequent."""
    made = TokenAligner.__init__
    monkeypatch.setattr(TokenAligner, "__init__", lambda self, a, b: made(self, a, b, most_frequent=frequent))
    found = op12_token_alignment(spark, documents)
    assert [t for n, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert got == {(i if i != 5 else None): x for i, x in enumerate(plain(TEXTS))}


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op12_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], plain([r["text"] for r in rows])))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    aligner = TokenAligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert aligner.summary(none).collect() == []


def test_links_and_shared_groups(spark):
    aligner = TokenAligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    row = aligner.alignments(spark.createDataFrame([(1, "unbelievable")], "doc_id long, text string")).first()
    first, second = (x.split(",") for x in row["groups"].split("|"))
    assert row["n_shared"] == len(first) * len(second) and sum(row["n"]) <= row["n_shared"]
    assert set(map(str, row["a"])) == set(first) and set(map(str, row["b"])) == set(second)


def test_products_of_sparse_matrices():
    r = np.random.default_rng(2)
    left, right = r.integers(0, 3, (7, 11)) * (r.random((7, 11)) < 0.4), r.integers(0, 4, (11, 5)) * (r.random((11, 5)) < 0.5)

    def sparse(m):
        row, column = np.nonzero(m)
        return Rows.of(row, column, m[row, column], *m.shape)

    def dense(s):
        out = np.zeros((len(s.begin) - 1, s.width), "int64")
        out[s.row, s.column] = s.value
        return out

    assert (dense(sparse(left).times(sparse(right))) == left @ right).all()
    assert (dense(sparse(left).transposed()) == left.T).all()
    assert dense(sparse(left * 0).times(sparse(right))).sum() == 0


def test_words_are_those_of_the_library():
    coder = ByteLevel(vocabulary("byte_bpe_50k.json"))
    random.seed(5)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "Zu", "é", "ß", "9", "42", "'s", "'LL", "'", "!", "?!", "²", "ª", "½", "-", "<|endoftext|>"]
    texts = [" " + "".join(random.choices(parts, k=random.randint(1, 30))) for _ in range(2000)]
    assert not any(coder.UNUSUAL.search(t) for t in texts)
    want = [x.ids for x in coder.library.encode_batch(texts, add_special_tokens=False)]
    assert coder.by_rank and coder.encode(texts) == want
    coder.by_rank = None
    assert coder.encode(texts) == want
    assert len(Pieces(vocabulary("piece_bpe_32k.model")).tokens) == 32000
