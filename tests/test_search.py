import random
import re

from tickscope import schemas
from tickscope.operators import search as S
from tickscope.session import stored


def test_mandatory_grams():
    assert S.mandatory_grams("knife") == ["ife", "kni", "nif"]
    assert S.mandatory_grams("kn%fe") == S.mandatory_grams("") == S.mandatory_grams("ab_cd") == []
    assert S.mandatory_grams("ab\\%c") == ["ab%", "b%c"]


def matches(name, query):
    """LIKE by a regular expression."""
    pattern = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in query.lower())
    return bool(query) and name is not None and re.search(pattern, name.lower(), re.DOTALL) is not None


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abAB é★|") for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "ab", "a%b_c", "a%b_c"]
    items = spark.createDataFrame([(i, n, "Agent", None) for i, n in enumerate(names)], schemas.MARKET_ITEMS)
    postings = stored(S.name_postings(items))
    for query in ["aba", "ABA", "ab%ba", "a_b", "abab", "★a|", "éa", "b", "%", "", "ab b%a★", "bbb_aaa%b"]:
        wanted = sorted(i for i, n in enumerate(names) if matches(n, query))
        assert sorted(r.id for r in S.matching_items(items, query, postings).collect()) == wanted, query
        assert sorted(r.id for r in S.matching_items(items, query).collect()) == wanted, query
    assert [r.id for r in S.matching_items(items, "a\\%b\\_c", postings).collect()] == [403, 404]
    assert S.name_postings(items.limit(0)).count() == 0


def test_the_scan_reads_the_grams_of_the_query(spark):
    items = spark.createDataFrame([(1, "★ Knife", "Knife", None)], schemas.MARKET_ITEMS)
    found = S.matching_items(items, "knif", stored(S.name_postings(items)))
    assert "In(gram, [kni,nif])" in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == items.columns
