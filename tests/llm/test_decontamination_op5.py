from hypothesis import given, settings, strategies as st

from tidewatch.llm.decontamination import Finder, budget, contaminated, cut, drop_contaminated, nearest, plain

TEXT = st.text(alphabet="ab c", max_size=40)


def edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@given(TEXT, TEXT)
@settings(max_examples=300, deadline=None)
def test_distance(pattern, text):
    assert nearest(pattern, text) == (edit(pattern, text) if pattern else 0)


@given(st.lists(st.text(alphabet="ab c", min_size=5, max_size=30), min_size=1, max_size=3), st.text(alphabet="ab c", max_size=80))
@settings(max_examples=300, deadline=None)
def test_finder_loses_nothing(items, text):
    items, text = [(k, plain(t)) for k, t in enumerate(items)], plain(text)
    want = {}
    for key, item in items:
        if pattern := item.strip():
            pattern = pattern if len(pattern) >= 6 else f" {pattern} "
            if (d := edit(pattern, text)) <= budget(len(pattern), 6):
                want[key] = d
    assert dict(Finder(items, 6).hits(text)) == want


def test_pieces_cover_the_pattern():
    found = cut("abcdefghij", 3)
    assert "".join(p for _, p in found) == "abcdefghij" and len(found) == 4


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards hum a tune"


def test_edited_passages(spark, make):
    bench = spark.createDataFrame([(1, ITEM), (2, "Unrelated question about rivers and their names"), (3, None), (4, " ! ")], "item_id long, text string")
    docs = make(
        "start " + ITEM + " end", "x " + ITEM.upper().replace(" ", " \n "), ITEM.replace("quick", "quikc"),
        ITEM[: len(ITEM) // 2], "nothing here", None, "", "y " * 20_000 + ITEM.replace("wizards", "lizards"))
    got = {(r.doc_id, r.item_id): r.distance for r in contaminated(docs, bench).collect()}
    assert got == {(0, 1): 0, (1, 1): 0, (2, 1): 2, (7, 1): 1}
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [3, 4, 5, 6]


def test_odd_documents(spark, odd, none):
    bench = spark.createDataFrame([(1, "twice the same text"), (1, "twice the same text"), (None, "no id"), (5, "zzz")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in contaminated(odd, bench).collect()), key=str)
    assert got == [(7, 1, 0), (8, 1, 0), (None, None, 0)]
    kept = drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5  # rows without id go together
    assert contaminated(none, bench).count() == 0
    assert contaminated(odd, bench.limit(0)).count() == 0
