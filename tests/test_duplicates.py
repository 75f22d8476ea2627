import random

from cairnspark.operators import duplicates


def test_pairs_without_a_common_word_or_beginning_are_found(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    names = ["axchemical brokeering", "achemical brokering", "  ", "ab", "abc", "Ab"]
    for _ in range(40):
        name = " ".join(word(rng.randint(4, 12)) for _ in range(rng.randint(1, 3)))
        at = rng.randrange(len(name))
        names += [name, name[:at] + "x" + name[at + 1 :], "x" + name]
    nodes = spark.createDataFrame([(f"n{i}", "tool", n) for i, n in enumerate(names)], "node_id string, type string, name string")
    found, want = ({tuple(r) for r in duplicates.possible_duplicates(nodes, 90, 10_000, exhaustive=e).collect()} for e in (False, True))
    assert found == want and ("n0", "n1") in {r[:2] for r in want}


def test_shared_run_at_some_thresholds():
    assert duplicates.shared_run(90) == 3 and duplicates.shared_run(50) == 1 and duplicates.shared_run(0) == 0
