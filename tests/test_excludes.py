"""One expression for all patterns against each pattern by itself."""

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.operators import filters

letters = st.sampled_from("ab/.-^]\\[&|~ é")
words = st.lists(st.text(letters, min_size=1, max_size=5), min_size=1, max_size=12)


@settings(max_examples=300, deadline=None)
@given(words, st.lists(st.text(letters, max_size=12), max_size=8))
def test_trie_matches_what_any_word_matches(some, texts):
    trie = re.compile(filters.trie_regex(some))
    for t in texts + some:
        assert bool(trie.search(t)) == any(w in t for w in some), (some, t, trie.pattern)


def one_by_one(patterns, path):
    """Each pattern by itself, as it was written."""
    for p in (x.strip() for x in patterns):
        try:
            if p and filters._GLOB.search(p):
                if re.search(filters.glob_regex(p).removesuffix(r"\z") + r"\Z", path):
                    return True
                continue
        except filters.BadGlob:
            pass
        if p and p.lower() in path.lower():
            return True
    return False


def generated(r, n):
    part = lambda: "".join(r.choice("abcXY.é-") for _ in range(r.randrange(1, 4)))
    kinds = (part, lambda: "*." + part(), lambda: "**/" + part(), lambda: f"/r/{part()}*", lambda: "/r/{" + part() + "," + part() + "}/?" + part(), lambda: "[" + part(), lambda: f"*/[!{r.choice('ab')}]{part()}", lambda: "")
    return [r.choice(kinds)() for _ in range(n)]


def test_excludes_equal_each_pattern_by_itself(spark):
    r = random.Random(8)
    paths = ["/r/" + "/".join("".join(r.choice("abcXY.é-") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 5))) for _ in range(150)]
    df = spark.createDataFrame([(p, "/r") for p in paths], "path string, root_path string")
    for n in (1, 4, 12):
        patterns = generated(r, n)
        x = filters.Excludes(patterns)
        assert [x.matches(p) for p in paths] == [one_by_one(patterns, p) for p in paths], patterns

        def excluded(p, patterns=patterns):
            parts = p.split("/")
            return any(one_by_one(patterns, "/".join(parts[:k])) for k in range(3, len(parts) + 1))

        assert sorted(q["path"] for q in x.prune(df).select("path").collect()) == sorted(p for p in paths if not excluded(p)), patterns


def test_cost_does_not_grow_with_the_patterns():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    paths = ["/" + "/".join(word() for _ in range(8)) for _ in range(3000)]

    def seconds(n):
        x, best = filters.Excludes([word() for _ in range(n)]), 9.0
        for _ in range(3):
            began = time.process_time()
            assert not any(x.matches(p) for p in paths)
            best = min(best, time.process_time() - began)
        return best

    assert seconds(8000) < 20 * seconds(100)  # the letters bound it; one by one it is 80 times


def test_a_long_word_and_no_words():
    x = filters.Excludes(["a" * 5000, "a" * 5000 + "b"])
    assert x.matches("/" + "a" * 5001) and not x.matches("/" + "a" * 4999)
    assert not filters.Excludes([" ", ""]).matches("/x")
