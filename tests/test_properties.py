from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators import sequences

WORDS = st.lists(st.sampled_from("a b c d e".split()), max_size=12)


@settings(max_examples=80, deadline=None)
@given(WORDS, WORDS)
def test_diff_accounts_for_every_word(a, b):
    out = sequences.diff(a, b)
    assert out["ok"] + out["missed"] == len(a) and out["ok"] + out["extra"] == len(b)
    pairs = sequences.common(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))


@settings(max_examples=80, deadline=None)
@given(WORDS)
def test_a_text_carries_its_tags_to_itself(a):
    tags = [str(i) for i in range(len(a))]
    assert sequences.carried(a, tags, a) == tags


@settings(max_examples=80, deadline=None)
@given(WORDS, WORDS)
def test_a_tag_is_used_once(a, b):
    tags = [str(i) for i in range(len(a))]
    used = [t for t in sequences.carried(a, tags, b) if t is not None]
    assert len(used) == len(set(used))


@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
@settings(max_examples=150, deadline=None)
def test_common_is_longest_and_most_unbroken(a, b):
    def best(i, j, before):
        if i == len(a) or j == len(b):
            return (0, 0)
        out = max(best(i + 1, j, False), best(i, j + 1, False))
        if a[i] == b[j]:
            length, runs = best(i + 1, j + 1, True)
            out = max(out, (length + 1, runs + before))
        return out

    pairs = sequences.common(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert (len(pairs), sum((i + 1, j + 1) in pairs for i, j in pairs)) == best(0, 0, False)
