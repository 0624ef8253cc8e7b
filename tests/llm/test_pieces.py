import pyarrow as pa
import pytest

from timeloom.llm import pieces
from timeloom.llm.queries import vocabulary


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(vocabulary())


def every_path(m, part):
    """All segmentations of a short part, best first: each way to cut it whose
    spans are pieces, or single signs that no piece is."""
    out = []
    for cuts in range(1 << max(0, len(part) - 1)):
        at = [0, *(k + 1 for k in range(len(part) - 1) if cuts >> k & 1), len(part)]
        score, ids = 0, ()
        for span in (part[a:b] for a, b in zip(at, at[1:])):
            v = m.normal.get(span)
            if v is None and len(span) == 1:
                raw = span.encode()
                v = (*(m.byte_id[b] for b in raw), m.floor * len(raw))
            if v is None:
                break
            score, ids = score + v[-1], ids + v[:-1]
        else:
            out.append((score, ids))
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["", "a", "Hello", "the cat", "a  b", "x\ny", "né 漢🙂", "it's, (ok).", "  ", "aaaaaaa", " Se.&&&", "abababab"])
def test_nbest_is_exact(model, text):
    got = model.nbest(text, 6)
    want = every_path(model, model.normalise(text)) if text else [(0, ())]
    assert [s for s, _ in got] == [s / pieces.SCALE for s, _ in want[:6]]
    assert all(model.decode(ids) == text for _, ids in got)
    by_ids = {ids: s for s, ids in want}
    assert len({tuple(ids) for _, ids in got}) == len(got) and all(by_ids[tuple(ids)] == s * pieces.SCALE for s, ids in got)


def test_bulk_leads_equal_single_ones(model):
    texts = ("The quick, brown fox. Jumps! over;", "Größe ñandú çedilla éèê", "a1 b2|c3 %%% \\x Se.&&&", "aaaaaaaaaaaaaaaaaaaaaaaaaa bbbbbbbb ababababab", "漢字 x漢 \x07", "x" * 300)
    parts = sorted({p for t in texts for p in model.parts(t)})
    bulk = pieces.PieceModel(vocabulary())
    bulk.leads(parts)
    known = bulk.known
    assert known.parts == list(known.at) and sorted(known.at) == parts
    for p, k in known.at.items():
        one = model.search(p, 2)
        assert (known.score[k], tuple(known.ids[known.ends[k] : known.ends[k + 1]])) == one[0]
        assert known.gap[k] == (one[0][0] - one[1][0] if len(one) > 1 else -1)
        assert model._joined(one[0][1]) == p


def test_long_parts_without_spaces(model):
    for part in ("a" * 100_000, "ab" * 20_000, "=" * 50_000, "漢" * 30_000):
        got = model.search(part, 4)
        assert len({ids for _, ids in got}) == (1 if part[0] == "漢" else 4) and all(model._joined(ids) == part for _, ids in got)
        assert got[0][0] == model.forward(part)[-1] and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def test_forgetting_changes_nothing(model, monkeypatch):
    texts = [f"word{k} the cat {k} né 漢 sat" for k in range(50)]
    few = pieces.PieceModel(vocabulary())
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    monkeypatch.setattr(pieces, "TOGETHER", 100)
    monkeypatch.setattr(pieces, "HANDED_ON", 50)
    monkeypatch.setattr(pieces, "model_of", lambda path: few)
    batch = pa.RecordBatch.from_pydict({"key": list(range(50)), "text": texts})
    rows = [r for b in pieces._segment("", 3, iter([batch])) for r in b.to_pylist()]
    assert len(few.known.at) < 60 and [r["key"] for r in rows] == list(range(50))
    for r, text in zip(rows, texts):
        want = model.nbest(text, 3)
        assert r["scores"] == [s for s, _ in want] and [r["ids"], *r["more_ids"]] == [x for _, x in want] and r["round_trip"]


def test_english_is_cut_as_the_library_does(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    text = "The quick brown fox jumps over the lazy dog. Machine learning models are trained on large corpora of text, which are often collected from the web."
    assert model.nbest(text, 1)[0][1] == sp.encode(text)
    assert pieces._weights([-0.5, -1.25]) == [-32768, -81920]


def test_decoding_agrees_with_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    for text in ("Hello world", "a  b\n漢🙂", "it's ok"):
        ids = model.nbest(text, 1)[0][1]
        assert sp.decode(ids) == text == model.decode(sp.encode(text))


def test_table(spark):
    rows = [(1, None), (2, "Hello world"), (2, "Hello world"), (3, "a▁b"), (None, "x"), (4, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as ids", "6 as score")
    enc = pieces.segment(docs, vocabulary(), n=3)
    got = {r["doc_id"]: r for r in enc.collect()}
    assert got[1]["n_pieces"] == 0 and got[1]["scores"] == [0.0] and len(got[2]["scores"]) == 3 and not got[3]["round_trip"] and got[4]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(enc, vocabulary()).collect()}
    assert back[2] == "Hello world" and back[1] == "" and back[3] == "a b" and back[4] == "long " * 50_000
    assert pieces.segment(docs.limit(0), vocabulary()).count() == 0


def test_segments_are_the_n_best(spark, model):
    texts = ["", "a", "the cat", "né 漢🙂", "it's, (ok).", "aaaaaaa", "Hello world. " * 40, "a▁b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.segment(docs, vocabulary(), n=4).collect()}
    for k, text in enumerate(texts):
        r, lists = got[k], [got[k]["ids"], *got[k]["more_ids"]]
        assert len(lists) == len(r["scores"]) == len(set(map(tuple, lists)))
        assert r["scores"] == pytest.approx([s for s, _ in model.nbest(text, 4)])
        if len(text) < 12:
            by_ids = {ids: s / pieces.SCALE for s, ids in every_path(model, model.normalise(text))} if text else {(): 0}
            assert r["scores"] == [by_ids[tuple(x)] for x in lists]
        assert r["round_trip"] == all(model.decode(x) == text for x in lists) == ("▁" not in text)


def test_round_trip_decodes(spark, monkeypatch, model):
    monkeypatch.setattr(pieces, "model_of", lambda path: model)
    monkeypatch.setattr(model, "decode_many", lambda lists: ["other"] * len(lists))
    batch = pa.RecordBatch.from_pydict({"key": [1], "text": ["Hello world"]})
    assert next(pieces._segment("", 4, iter([batch])))["round_trip"].to_pylist() == [False]


def test_many_decoded_as_one(model):
    b = model.byte_id
    lists = [[], [b[0xC3], b[0xA9]], [b[0xC3], 500, b[0xA9]], [model.unknown, 600, b[10], *sorted(model.skip)], [b[0xE6], b[65], b[0xE6], b[0xBC]], list(range(len(model.pieces)))]
    assert model.decode_many(pa.array(lists, pa.list_(pa.int32()))) == [model.decode(x) for x in lists]
