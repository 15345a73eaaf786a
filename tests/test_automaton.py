"""The token automaton against plain search, the block in one pass and in several."""

import random

from sievewright.functions.automaton import Phrases, Vocabulary, words
from sievewright.operators import lexblock


def test_phrases_against_plain_search():
    rng = random.Random(1)
    for _ in range(300):
        phrases = [tuple(rng.choice("abc") for _ in range(rng.randrange(0, 5))) for _ in range(12)]
        tokens = [rng.choice("abcd") for _ in range(rng.randrange(0, 25))]
        body = " " + " ".join(tokens) + " "
        assert Phrases(phrases).found(tokens) == {i for i, p in enumerate(phrases) if p and f" {' '.join(p)} " in body}


def test_vocabulary_counts_terms_and_groups():
    v = Vocabulary(["steel", "flow"], [["steel flow", "flow"], [], ["no such", "", "Steel-Flow"]])
    assert v.read("Steel flow, STEEL/flow; flowing") == (5, [(0, 2), (1, 2)], [2, 0, 1])
    assert v.read(None) == (0, [], [0, 0, 0]) and words("a-b/C é1") == ["a", "b", "c", "1"]


def test_many_terms_cost_what_few_do():
    text, few = [f"t{i % 50}" for i in range(2000)], Phrases([("t1", "t2")])
    many = Phrases([("t1", "t2")] + [(f"x{i}", f"y{i}") for i in range(10000)])
    assert many.found(text) == few.found(text) == {0} and len(many.next) == 20003


def test_block_in_several_passes(spark):
    papers = spark.createDataFrame([(i, f"s{i % 7}", f"alpha beta w{i % 5} gamma delta " * (i % 4)) for i in range(80)], "paper_id long, silo string, text string")
    briefs = spark.createDataFrame([(f"s{i}", 0, f"alpha w{i}", "beta", "delta", ["alpha beta", f"w{i}"], ["gamma"], ["zeta"] if i else []) for i in range(6)], "silo string, item_id int, obj string, prob string, dom string, must array<string>, nice array<string>, exclude array<string>")
    one = sorted(map(tuple, lexblock.lexical_block(papers, briefs).collect()))
    assert len(one) == sum(i % 7 < 6 for i in range(80))
    assert sorted(map(tuple, lexblock.lexical_block(papers, briefs, terms=9).collect())) == one
    assert lexblock.lexical_block(papers.limit(0), briefs).count() == lexblock.lexical_block(papers, briefs.limit(0)).count() == 0


def test_variants_of_a_brief_equal_blocks_of_their_own(spark):
    papers = spark.createDataFrame([(i, f"s{i % 3}", f"alpha beta w{i % 5} gamma delta " * (i % 4)) for i in range(40)], "paper_id long, silo string, text string")
    schema = "silo string, variant string, item_id int, obj string, prob string, dom string, must array<string>, nice array<string>, exclude array<string>"
    briefs = spark.createDataFrame([(f"s{i}", v, 0, o, "beta", "delta", m, ["gamma"], ["zeta"]) for i in range(3) for v, o, m in (("full", f"alpha w{i}", ["alpha beta"]), ("no_must", f"alpha w{i}", []), ("bare", "", ["w1", "beta w2"]))], schema)
    got = lexblock.block_variants(papers, briefs, ["bm25_obj"])
    for v in ("full", "no_must", "bare"):
        one = lexblock.lexical_block(papers, briefs.where(briefs.variant == v), ["bm25_obj"])
        assert sorted(map(tuple, got.where(got.variant == v).drop("variant").collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)
