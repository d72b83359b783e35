import pytest

from quarrystone.errors import InvalidArgument
from quarrystone.functions.text import ascii_tokens_of, tokens_of
from quarrystone.plans import budget, filters, rank


@pytest.mark.parametrize(
    "tree",
    [[], ["a"], ["a", "eq"], ["a", "like", 1], ["and"], ["not", ["a", "eq", 1], ["b", "eq", 1]], ["a", "eq", [1]], ["a", "in", []], ["a", "in", [[1]]], ["a", "regex", "("], ["a", "regex", "(?=x)"], ["a", "regex", r"(a)\1"], ["a", "glob", ""], ["a", "regex", "x" * 513], ["a", "tokens", 1], ["", "eq", 1], "a"],
)
def test_bad_filters(tree):
    with pytest.raises(InvalidArgument):
        filters.parse(tree)


def test_filter_shapes():
    a, b = filters.Leaf("eq", "x", 1), filters.Leaf("in", "y", (1, 1.0, True))
    assert filters.parse(["AND", [["x", "=", 1], ["And", ["y", "in", [1, 1.0, True, 1]]]]]) == filters.Group("and", (a, b))
    assert filters.parse(["eq", "x", 1]) == a
    assert filters.parse(["t", "ContainsAllTokens", "A b, a"]).value == ("a", "b")
    assert filters.parse(["t", "glob", "a.*?"]).value == r"(?ds)\Aa\..*.\z"
    assert filters.parse(["t", "regex", "[$]a$"]).value == r"(?d)[$]a\z"


@pytest.mark.parametrize(
    ("tree", "reason"),
    [
        (["sum"], "SHAPE"),
        ([], "SHAPE"),
        (["body", "bm25", " "], "BM25_QUERY"),
        (["body", "prefix", 1], "PREFIX_QUERY"),
        (["body", "near", "x"], "UNSUPPORTED_OPERATOR"),
        (["product", -1, ["body", "bm25", "x"]], "PRODUCT_WEIGHT"),
        (["rank_by_filter", ["x"], ["body", "bm25", "x"], 2], "RANK_BY_FILTER"),
        (["vector", "ann", []], "VECTOR_SHAPE"),
        (["sum", ["vector", "ann", [1]], ["body", "bm25", "x"]], "MIXED_SEMANTICS"),
    ],
)
def test_bad_ranks(tree, reason):
    with pytest.raises(InvalidArgument) as e:
        rank.parse(tree)
    assert e.value.reason == f"RANK_EXPR_{reason}"


def test_deep_rank():
    tree = ["body", "bm25", "x"]
    for _ in range(40):
        tree = ["max", tree]
    with pytest.raises(InvalidArgument) as e:
        rank.parse(tree)
    assert e.value.reason == "RANK_EXPR_DEPTH"


def test_normalised_ranks():
    x, y = ["a", "bm25", "x"], ["b", "bm25", "y"]
    assert rank.parse(["sum", y, ["sum", x]]) == rank.parse(["sum", x, y])
    assert rank.parse(["product", 2, ["product", 0.5, x]]) == rank.parse(x)
    assert rank.parse(["rank_by_filter", ["t", "eq", 1], x, 0]) == rank.parse(x)
    assert rank.linear(rank.parse(["sum", x, ["product", 3, y]])) and not rank.linear(rank.parse(["max", x, y]))
    assert rank.parse(["vector", "knn", [1, 2]]) == rank.VectorLeaf("exact", (1.0, 2.0))
    assert rank.parse(["text", "BM25", "x"]).field is None


def test_budget():
    assert budget.least_probes(3, 100, False) == 12 and budget.least_probes(10, 100, True) == 22 and budget.least_probes(99, 5, False) == 5
    assert budget.budget(10, 15_000, 122).candidates == 15_000
    b = budget.budget(10, 24_000, 155)
    assert b == budget.Budget(155 * 20, 21)
    assert budget.budget(10, 24_000, 155, True, 200).probes == 155
    assert budget.rerank_limit(10, 100) == 100 and budget.rerank_limit(10, 1000) == 50 and budget.rerank_limit(10, 10**6) == 2048
    assert budget.bucket_count(2_000) == 45 and budget.bucket_count(10**9) == 256 and budget.root_count(45) == 7


def test_tokens():
    assert tokens_of("Ünïcode 漢字-и И 42") == ["ünïcode", "漢字", "и", "42"]
    assert ascii_tokens_of("Ab-c é3") == ["ab", "c", "3"]
