from gridframe.llm import decontaminate


def words(name, n):
    return [f"{name}{i}" for i in range(n)]


def test_clean_is_the_same_for_any_block_size(spark):
    a, b = words("a", 14), words("b", 14)
    # The second item overlaps what the first cuts; the last two are hit to 40 per cent by each of two items.
    overlapping = [*a[4:], *words("c", 6)]
    items = [(1, " ".join(a)), (2, " ".join(overlapping)), (3, " ".join(b)), (4, " ".join([*b[:5], *words("joined", 5)]))]
    docs = [
        (1, [*words("x", 30), *a, *words("c", 6), *words("y", 30)]),
        (2, [*a, *words("x", 7), *b]),
        (3, [*words("x", 20), *b[:5], *a, *words("joined", 5), *words("z", 20)]),
        (4, words("x", 9)),
        (5, None),
    ]
    frame = spark.createDataFrame([(i, d and " ".join(d), i) for i, d in docs], "doc_id long, text string, spans int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.clean(frame, benchmark, block_words=n).collect())) for n in (2_000_000, 1))
    assert one == many
    assert [r[0] for r in one] == [1, 3, 4, 5]
    assert one[0][1].split() == [*words("x", 30), *words("y", 30)]
    assert one[1][1].split() == [*words("x", 20), *b[:5], *words("joined", 5), *words("z", 20)]
