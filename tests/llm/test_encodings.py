"""Chat templates, token files and SentencePiece coding."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from protosift.llm.chat_template import (
    TURN_CONTROLS,
    ChatFormatter,
    ChatTemplate,
    Const,
    Escaper,
    Print,
    TemplateError,
    read_turns,
)
from protosift.llm.piece_transducer import PieceCoder, PieceModel, Transducer
from protosift.llm.queries import vocabulary
from protosift.llm.token_store import TokenFile, TokenStore, WordEncoder, encode

# Chat templates


def render(source, controls=(), **values):
    template = ChatTemplate(source, controls)
    return template.render(values.pop("messages", []), **values)[0]


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ("a {{ 1 + 2 * 3 }} b", "a 7 b"),
        ("{{ 'x' ~ 1 ~ true ~ none }}", "x1true"),
        ("{% if n > 1 and not z %}many{% elif n == 1 %}one{% else %}none{% endif %}", "many"),
        ("{% for x in xs %}{{ loop.index }}{{ x.name | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", "1A, 2B"),
        ("{% set y = n + 1 %}{{ y if y is defined else 'no' }}{{ q is not defined }}", "3true"),
        ("  {%- if n -%}  x  {%- endif -%}  ", "x"),
        ("{{ xs[1]['name'] }}{{ xs[7].name }}{{ q.r.s | default('-') }}{# gone #}", "b-"),
        ("{{ 'b' in 'abc' }}{{ 'z' not in 'abc' }}{{ -n }}{{ xs | length }}", "truetrue-22"),
        ("{{ 'a\\n\\'b' }}", "a\n'b"),
    ],
)
def test_templates(source, wanted):
    assert render(source, n=2, z=False, xs=[{"name": "a"}, {"name": "b"}]) == wanted


@pytest.mark.parametrize("source", ["{{ 1 + }}", "{% if x %}", "{{ x | nope }}", "{% for x xs %}{% endfor %}", "{{ f(1) }}", "{% end %}", "{{ a $ b }}"])
def test_bad_templates(source):
    with pytest.raises(TemplateError):
        ChatTemplate(source, ())


def test_sandbox():
    assert render("{{ x.__class__ }}{{ x['__len__'] }}", x="text") == ""
    with pytest.raises(TemplateError):
        render("{{ x }}", x={"a": 1})


def test_constants_are_folded():
    template = ChatTemplate("a{{ 1 + 1 }}{% if 1 > 2 %}b{% else %}c{{ 'D' | lower }}{% endif %}{% if x and false %}{% endif %}", ())
    assert template.tree.nodes[0] == Print(Const("a2cd"))


def test_escapes_come_back():
    rng = random.Random(1)
    escaper = Escaper(TURN_CONTROLS)
    parts = [*TURN_CONTROLS, "\\", "<", "s>", "[", "/INST]", "x", "é", "\n", "]", "/"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        safe = escaper.escape(text)
        assert Escaper.unescape(safe) == text and not any(c in safe for c in TURN_CONTROLS)


def test_generation_spans_and_turns():
    rng = random.Random(2)
    template = ChatTemplate(ChatFormatter().source, TURN_CONTROLS)
    parts = [*TURN_CONTROLS, "\\", "<", "[", " ", "ok", "日", ""]
    for _ in range(500):
        messages = [
            {"role": rng.choice(["user", "assistant", "", "</s>"]), "text": "".join(rng.choice(parts) for _ in range(6))}
            for _ in range(rng.randint(0, 5))
        ]
        text, spans = template.render(messages)
        assert read_turns(text) == [(m["role"], m["text"]) for m in messages]
        said = [m["text"] for m in messages if m["role"] == "assistant"]
        assert [Escaper.unescape(text[a:b]) for a, b in spans] == said


def test_formatting_a_table(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", None), (2, 0, None, "[INST]"), (None, 5, "user", "x"), (None, 4, "assistant", "")]
    turns = spark.createDataFrame([(*r, 8) for r in rows], "conv_id long, turn long, role string, text string, id int")
    read = {r.id: r for r in ChatFormatter.read_back(ChatFormatter().format(turns)).collect()}
    assert [tuple(t) for t in read[1].turns] == [("user", ""), ("user", ""), ("assistant", "b")] and read[1].loss == "b"
    assert [tuple(t) for t in read[2].turns] == [("", "[INST]")] and read[2].loss == ""
    assert [tuple(t) for t in read[None].turns] == [("assistant", ""), ("user", "x")]
    assert ChatFormatter.read_back(ChatFormatter().format(turns.limit(0))).collect() == []


# Token files


@pytest.mark.parametrize("most", [1, 200, 300, 49_407, 70_000, 2**32 - 1])
def test_any_token_without_decoding_a_block(most):
    rng = np.random.default_rng(most)
    ids = (rng.random(7000) ** 4 * most).astype(np.uint32)
    file = TokenFile(encode(ids, np.array([5, 9, 2]), np.array([0, 3000, 7000])))
    at = rng.integers(0, 7000, 3000)
    assert (file.tokens(at) == ids[at]).all() and (file.span(0, 7000) == ids).all()
    assert (file.span(123, 5001) == ids[123:5001]).all() and (file.document(2) == ids[3000:]).all() and len(file.document(0)) == 0


def test_empty_and_damaged_files():
    raw = encode(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(TokenFile(raw).span(0, 0)) == 0
    raw = encode(np.arange(9, dtype=np.uint32), np.array([1]), np.array([9]))
    with pytest.raises(ValueError):
        TokenFile(raw[:-1] + b"\x07")


def test_documents_come_back_in_order(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = ["The", "thing's", " ", "  ", "\n", " ", "é", "é", "123", "日本", "😀", ".", "don't", " ", "\x1c", "ΣΑΣ", "###"]
    rows = [(i * 7 % 101, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(101)]
    rows += [(500, None), (501, ""), (502, "word " * 40_000)]
    docs = spark.createDataFrame([(*r, 4) for r in rows], "doc_id long, text string, start int")
    path = vocabulary("word_bpe_49k.json")
    found = {r.id: r for r in TokenStore(path, 2).round_trip(docs).collect()}
    tokenizer, start = Tokenizer.from_file(path), 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (found[i].start, found[i].n_tokens) == (start, len(ids))
        assert found[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert TokenStore(path, 2).round_trip(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    "text",
    ["abc <|endoftext|> def", "abc<|startoftext|>Def\n<|endoftext|>", "<|ENDOFTEXT|> a", "<|endoftext|>.", "a <|endoftext |> b"]
    + [f"Über x{mark}ura. {mark} é" for mark in ("J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "\u03aa\u0301", "E\u0301", "\u212b", "e\u0327\u0301")],
)
def test_ids_are_those_of_the_library(text):
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"))
    wanted = encoder.tokenizer.__class__.from_file(vocabulary("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids
    ids, ends = encoder.encode(["Plain words", text, "plain"], 2)
    assert ids[ends[0] : ends[1]].tolist() == [*wanted, 2]


# SentencePiece

PIECES = ["a", "e", "th", "in", " ", "  ", "    ", "\n", "\t", "é", "ñ", "日本", "😀", "▁", ".", "S", "The", "ing", "12", "<s>", "\r", "==", "--"]


def odd_texts(seed, count):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(count)]
    return texts + [" " * k for k in range(40)] + ["a" + " " * k + "b" for k in range(40)] + ["", "x" * 3000]


def test_merges_equal_the_library():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), Transducer(PieceModel.of(path))
    texts = odd_texts(1, 1500)
    ids = mine.encode(texts)
    assert ids == library.encode(texts)
    assert mine.decode(ids) == library.decode(ids) == [t.replace("▁", " ") for t in texts]


def test_unigram_takes_the_shortest_path():
    """A small model of scores against all ways to split a text."""
    pieces = ["<unk>", "<0x78>", "▁", "a", "b", "ab", "▁a", "bab", "aba", "▁ab"]
    weights = np.array([0, 0, 3.0, 2.0, 2.2, 3.1, 4.0, 4.1, 4.9, 5.2])
    kinds = np.array([2, 6, 1, 1, 1, 1, 1, 1, 1, 1])
    model = PieceModel(pieces, weights, False, True, {ord("x"): 1}, 0, kinds == 1, np.arange(10), np.arange(10), np.arange(10), kinds)
    mine = Transducer(model)

    def best(text):
        costs = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            ways = [
                (costs[end - len(p)][0] + weights[i], [*costs[end - len(p)][1], i])
                for i, p in enumerate(pieces)
                if kinds[i] == 1 and text[:end].endswith(p) and end - len(p) in costs
            ]
            if text[end - 1] == "x":
                ways.append((costs[end - 1][0] + weights.max() + 10, [*costs[end - 1][1], 1]))
            costs[end] = min(ways)
        return costs[len(text)]

    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abx ") for _ in range(rng.randint(1, 12)))
        found, (cost, wanted) = mine.encode([text])[0], best("▁" + text.replace(" ", "▁"))
        assert found == wanted or sum(weights[i] if i != 1 else weights.max() + 10 for i in found) == pytest.approx(cost)


def test_coding_a_table(spark):
    texts = [None, "", "The  thing.\n", "The  thing.\n", "é" * 50_000, *odd_texts(5, 40)]
    rows = [(i, t, "old") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coder = PieceCoder(vocabulary("piece_bpe_32k.model"))
    coded = coder.decode(coder.encode(docs)).orderBy("doc_id").collect()
    assert [r.decoded for r in coded] == [t if t is None else t.replace("▁", " ") for t in texts]
    assert coded[0].ids is None and coded[1].ids == []
    whole = coder.round_trip(docs).orderBy("doc_id").collect()
    assert [r.ids for r in whole] == [r.ids for r in coded] and all(r.restored for r in whole)
    assert coder.encode(docs.limit(0)).collect() == []


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    parts = {"aa": ("ba", "bo", "bi", "lo", "ka"), "xx": ("zyq", "xzz", "qyx", "wik")}

    def prose(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(2, 5))) for _ in range(n))

    rows = [(i, prose(lang, 60), lang) for i, lang in enumerate(["aa", "xx"] * 40)]
    passage = prose("aa", 30)
    copy = rows[5][1].split()
    copy[3] = "other"
    rows += [(100, rows[3][1], "xx"), (101, " ".join(copy), "xx"), (102, None, "aa"), (103, "12 34 ...", "aa")]
    rows += [(104, f"{prose('aa', 20)} {passage} {prose('aa', 9)}", "aa"), (105, f"{prose('xx', 30)} password=0123456789abcdef01 ok", "xx")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    ids, now = {r[0] for r in rows}, docs
    gone = [{102, 103}, {100, 101}, {104}, set()]
    for (_, stage), lost in zip(pipeline.STAGES[:-1], gone, strict=True):
        now = stage(spark, now, folder)
        ids -= lost
        assert now.schema.names == docs.schema.names and {r.doc_id for r in now.select("doc_id").collect()} == ids
    masked = now.where("doc_id = 105").first()
    assert masked.text.endswith("[SECRET] ok") and masked.n_chars == len(masked.text)
    coded = pipeline.run(spark, folder)
    assert coded.columns == ["doc_id", "n_ids", "ids"]
    assert {r.doc_id for r in coded.collect()} == ids
    coder = PieceCoder(vocabulary("piece_bpe_32k.model"))
    back = coder.decode(coded).where(F.col("doc_id") == 0).first().decoded
    assert back == rows[0][1]


def test_pipeline_keeps_columns_of_clashing_names(spark, tmp_path):
    import corpus_pipeline as pipeline

    text = "a few plain words of some length that nobody wrote before"
    rows = [(1, text, "aa", 7, 8, 9), (2, text, "aa", 5, 5, 5), (None, "words " * 60, "aa", 1, 2, 3), (4, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _predicted int, _leaks int, _row int")
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(1, "nothing of this kind is there at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = docs
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
    assert sorted(map(tuple, now.collect()), key=str) == sorted((rows[0], rows[2]), key=str)
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    assert pipeline.run(spark, folder).collect() == []


def test_null_ids_leave_other_ids_alone(spark):
    """2**53 + 1 is no floating number."""
    rows = [(None, "one"), (2**53 + 1, "two"), (5, "three"), (None, None), (-3, "four")]
    store = TokenStore(vocabulary("word_bpe_49k.json"), end_id=2)
    found = store.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"] is not None, r["id"] or 0) for r in found) == [(False, 0), (False, 0), (True, -3), (True, 5), (True, 2**53 + 1)]
    ends = {r["start"] + r["n_tokens"] for r in found}
    assert {r["start"] for r in found} - {0} <= ends and max(ends) == sum(r["n_tokens"] for r in found)
