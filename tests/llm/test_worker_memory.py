"""What workers remember is bounded in bytes, and one operator's memory goes when another asks."""
import random

import numpy as np

from qtrail.llm import _common as C
from qtrail.llm import language_id, packing
from qtrail.llm.queries import WORDS


def test_one_owner_at_a_time():
    made = []
    first = C.per_worker("a", 1, lambda: made.append("a1") or {"big": 1})
    assert C.per_worker("a", 1, lambda: made.append("again")) is first
    C.per_worker("b", 1, lambda: made.append("b1"))
    C.per_worker("a", 1, lambda: made.append("a1 anew"))
    assert made == ["a1", "b1", "a1 anew"] and len(C._kept) == 2


def test_budget_counts_bytes():
    budget = C.Budget(10_000)
    assert not budget.spent(["x" * 1000] * 5) and budget.spent(["x" * 5000]) and not budget.spent(["x"])


def test_long_words_are_forgotten_and_caches_emptied(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 20_000)
    ids = packing.WordIds(WORDS)
    million = "y" * 1_000_000
    a, b = ids.encode([f"one {million} two", "one two"])
    assert a.startswith(b[:4]) and all(len(w) <= C.LONG_WORD for words in (ids.known, ids.plain) for w in words)
    for i in range(30):
        ids.encode([" ".join(f"w{i}x{k}" for k in range(20))])
    assert sum(map(len, ids.known)) + 200 * len(ids.known) <= 20_000
    assert ids.encode(["one two"]) == [b]


def test_frequent_words_outlive_a_generation(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 20_000)
    ids = packing.WordIds(WORDS)
    learnt = []
    monkeypatch.setattr(ids, "_learn", lambda words, learn=ids._learn: (learnt.extend(words), learn(words)))
    plain = packing.WordIds(WORDS)
    for i in range(30):
        text = "often! " + " ".join(f"rare{chr(97 + i % 26)}{chr(97 + k)}" for k in range(20))
        assert ids.encode([text]) == plain.encode([text])
    assert learnt.count("often!") == 1
    assert 200 * sum(len(d) for d in (ids.known, ids.older[0])) <= 20_000 + 2 * 200 * 21


def test_signs_behind_words():
    ids = packing.WordIds(WORDS)
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    for text in [f"abc{a}{b} \u00c9t\u00e9{b}{a} 's{a}" for a in signs for b in ["", *signs[::5]]]:
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.encode([text])[0], "<u4").tolist() == want


def test_a_word_is_looked_up_once_a_call():
    """Words that repeat in a call are found as arrays, not one by one."""
    class Asked(dict):
        n = 0

        def __getitem__(self, word):
            self.n += 1
            return super().__getitem__(word)

        def get(self, word, other=None):
            self.n += 1
            return super().get(word, other)

    ids = packing.WordIds(WORDS)
    one = ids.encode(["one two, \x1cthree\x1c one"])
    ids.known = Asked(ids.known)
    assert ids.encode(["one two, \x1cthree\x1c one"] * 500 + ["", " \t\n"]) == one * 500 + [b"", b""]
    assert ids.known.n <= 10 and ids.encode([]) == []


def test_blanks_and_letters_of_all_kinds():
    rng = random.Random(7)
    letters = "abcXYZ \n\t\v,.!'\u2028\u3000\xa0\x85\x1c\x1f\u030a\u0338\xb5\xaaßéÉİΣς日🙂19<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 8, 90]))) for _ in range(2000)]
    texts += ["A<|endoftext|>b <|ENDOFTEXT|> don't,", "W\u030a w\u030a, =\u0338"]
    ids = packing.WordIds(WORDS)
    assert ids.bare is not ids.tokenizer
    found = [i for a in range(0, len(texts), 300) for i in ids.encode(texts[a:a + 300])]
    assert [np.frombuffer(i, "<u4").tolist() for i in found] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_letters_digits_and_signs_are_parted_as_arrays():
    """Only odd words (apostrophes, special tokens, other alphabets) pass the whole tokenizer."""
    class Whole:
        asked = []

        def encode_batch_fast(self, words, **_):
            self.asked.extend(words)
            return own.encode_batch_fast(words, **_)

    ids = packing.WordIds(WORDS)
    own, ids.tokenizer = ids.tokenizer, Whole()
    plain = "Abc a1b22C,, #7.x-Y! \u00c9t\u00e9; stra\u00dfe(2) \u00c0\u00fe&&& 100% <a|b>"
    odd = "don't a<|endoftext|>b 3\u00d74 \u03a3\u03b1 x\u030a"
    found = ids.encode([plain, odd, plain])
    assert [np.frombuffer(i, "<u4").tolist() for i in found] == [own.encode(t, add_special_tokens=False).ids for t in (plain, odd, plain)]
    assert sorted(Whole.asked) == sorted(odd.split())


def test_table_keeps_what_was_met():
    """Words without a slot, too long ones and ones of many ids are left to the dictionary; none is mistaken."""
    words = [f"{a}{b}" for a in "abcdefghijklmnop" for b in ("", "x", "x" * 14, "x" * 15, "x" * 16, "y" * 40)] + ["a\0", "\0", "q1234567"]
    table = packing._Table(38 * 64, np.dtype("<u2"))
    array = packing.pa.array(words, packing.pa.large_string())
    assert not table.find(array).any()
    count = np.array([9 if w == "q1234567" else 1 + k % 8 for k, w in enumerate(words)])
    flat = np.arange(count.sum()).astype("<u2")
    begin = np.cumsum(count) - count
    rest = set(table.put(np.arange(len(words)), flat, begin, count).tolist())
    held = np.flatnonzero(table.find(array))
    assert 30 < len(held) <= 64 and set(held.tolist()) | rest == set(range(len(words))) and not rest & set(held.tolist())
    assert all(len(words[k]) <= 16 and count[k] <= 8 for k in held) and sorted(table.words()) == sorted(words[k] for k in held)
    ids, n = table.of(held)
    assert n.tolist() == count[held].tolist()
    assert ids.tolist() == [int(i) for k in held for i in flat[begin[k]:begin[k] + count[k]]]
    both = packing.pa.concat_arrays([array.take(packing.pa.array(held)), packing.pa.array([f"new{k}" for k in range(500)], packing.pa.large_string())])
    new = np.flatnonzero(~table.find(both))
    table.put(new, np.zeros(500, "<u2"), np.arange(500), np.ones(500, int))
    assert table.find(both)[:len(held)].all()  # words met in a call stay through it


def test_short_words_met_before_are_no_strings(monkeypatch):
    ids = packing.WordIds(WORDS)
    text = "One two, three; Été straße x1 <y>. " * 3
    first = ids.encode([text])
    monkeypatch.setattr(ids, "_learn", None)
    assert ids.encode([text] * 3) == first * 3 and not ids.known


def test_language_words(monkeypatch):
    model = language_id.Model({"en": {"a": 5, " a": 3, "b": 2, " b": 2, "ab": 1}, "de": {"b": 5, " b": 4, "a": 1, " a": 1, "bb": 2}})
    scorer = language_id.Scorer(model)
    first = scorer.cross_entropies(["a ab", "z" * 1_000_000 + " a", "½ ² Ⅷ ① 12"])
    assert first[2][0] is None and set(scorer.known) == {"a", "ab"}
    again = scorer.cross_entropies(["a ab"])
    assert np.allclose(first[0][0], again[0][0])


def test_letters():
    assert language_id.words_of("x² ½ Ⅷ a1b Straße ΑΒΓ _q_") == ["x", "a", "b", "straße", "αβγ", "q"]
