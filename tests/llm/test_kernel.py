import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doseloom.llm.codepoints import blocks
from doseloom.llm.pieces import cut_block
from doseloom.llm.sentences import spans, transducer
from doseloom.llm.tokens import counter, encoding
from doseloom.llm.transducer import scan

any_text = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB 's'd.!?\n\t \"„“«»()[]-•12,กข।。")), max_size=60)


@given(st.lists(any_text, max_size=8))
@settings(max_examples=200, deadline=None)
def test_token_counts_equal_the_tokenizer(texts):
    assert counter().totals(pa.array(texts, pa.string())).tolist() == [len(encoding().encode_ordinary(t)) for t in texts]


def test_tokens_of_a_second_tokenizer_and_nulls():
    assert counter("byte_bpe_50k").totals(pa.array([None, "", "don't stop"], pa.string())).tolist() == [0, 0, len(encoding("byte_bpe_50k").encode_ordinary("don't stop"))]


@given(st.lists(st.integers(0, 22), max_size=300))
@settings(max_examples=100, deadline=None)
def test_parallel_scan_equals_one_by_one(symbols):
    t = transducer()
    s = np.array(symbols, np.uint8)
    assert (t.run(s) == t.run_one_by_one(s)).all()


def test_scan_composes():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 5, (37, 5)).astype(np.uint8)
    state, out = 3, scan(f)
    for i in range(37):
        state = f[i, state]
        assert out[i, 3] == state


@given(st.lists(any_text, max_size=6))
@settings(max_examples=200, deadline=None)
def test_spans_lie_in_order_and_hold_all_but_space_and_marks(texts):
    row, number, start, end = spans(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = [(a, b) for r, a, b in zip(row, start, end) if r == i]
        assert all(a < b for a, b in own) and all(x[1] <= y[0] for x, y in zip(own, own[1:]))
        assert all(not t[a].isspace() and not t[b - 1].isspace() or t[a] in "\x1c\x1d\x1e\x1f" or t[b - 1] in "\x1c\x1d\x1e\x1f" for a, b in own)
        rest = "".join(t[a:b] for a, b in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(t)]))
        assert all(c.isspace() or c in "-*•·" for c in rest)


def sentences(text):
    _, _, start, end = spans(pa.array([text]))
    return [text[a:b] for a, b in zip(start, end)]


@pytest.mark.parametrize(
    "text, count",
    [
        ("The max. dose is 2.5 mg, cf. Table 4.7, i.e. low. Next one.", 2),
        ('They were told: "Stop at once. Call us." and did so. "Is it safe?" 5 mg is.', 3),
        ("Of M. orvalis at 16 mcg/mL. See Fig. 3! Taken t.i.d. Then stopped.", 4),
        ("Older adults cleared it at 8 L/h... a finding still open.", 1),
        ("They need less.Patients came.", 2),
        ("„Mir ist übel. Bitte helfen Sie“, sagte sie. Am 64. Tag, d. h. spät. cosbrephyl wirkt.", 3),
        ("El paciente dijo: «Me siento mejor. Gracias.» y siguió. ¿Puede ser? Hubo p. ej. dos.", 3),
        ("« Arrêtez tout. Appelez-nous. » disait la notice. Peut-on ? M. le Dr. Un.", 3),
        ("Период 19,2 ч., т. е. почти сутки. См. разд. 5.3. «Мне лучше. Спасибо», — сказала она.", 3),
        ("患者は「良い。ありがとう。」と述べた。次は9.2項。", 2),
        ("患者说：“好。谢谢。”随后停用。约4.5%；较轻。", 2),
        ("ห้ามใช้ร่วมกับเครื่องดื่ม รับประทาน 2.5 มก. วันละ 62 ครั้ง ควรตรวจทุก 5 สัปดาห์", 3),
        ("डॉ. की सलाह के बिना बंद न करें। 26 दिन तक 40 मि.ग्रा. दवा दी गई।", 2),
        ("ظهر الدوار لدى 12.8% من المرضى، ثم زال. هل يمكن؟ لا!", 3),
        ("8.2 Storage\n\nKeep it\ncool. Dry.\n- one. two\n• three\n\nEnd", 6),
        ("no marks at all", 1),
        (" \n ", 0),
        ("", 0),
    ],
)
def test_sentences(text, count):
    assert len(sentences(text)) == count, sentences(text)


def test_list_marks_are_left_out():
    assert sentences("- one\n* two three") == ["one", "two three"]
    assert sentences("It ends.\n- one\n- two") == ["It ends.", "one", "two"]
    assert sentences("Broken by a dash\n- like this. Yes.") == ["Broken by a dash\n- like this.", "Yes."]


def test_pieces_of_hard_texts():
    texts = ["word " * 3000, "a" * 6000, "ก" * 4000, "x. " * 2000, "short", "", None, "One two. " * 400 + "\n\n" + "Three four. " * 400]
    c = counter()
    for block in blocks(pa.array(texts, pa.string())):
        for row, begin, end, tokens, shared in cut_block(block, 128, 16, c):
            t = texts[row] or ""
            assert begin[0] == 0 and end[-1] == len(t) and tokens.max() <= 128
            for k in range(1, len(begin)):
                assert begin[k] < end[k - 1] <= end[k] and shared[k] >= 16
            for a, b, n in zip(begin, end, tokens):
                assert len(c.encode(t[a:b])) <= 128 or n <= 128
            if row == 7:
                assert all(t[e - 1 : e + 1].strip().endswith(".") or t[e - 1] in ". \n" for e in end[:-1])


def brute_cost(ends, begins, price, limit, even, scale):
    """Least cost by recursion over all choices."""
    from functools import lru_cache

    @lru_cache
    def best(j):
        if j == 0:
            return 0.0
        return min((best(i) + scale * (ends[j - 1] - begins[i] - even) ** 2 + price[j - 1] for i in range(j) if ends[j - 1] - begins[i] <= limit), default=float("inf"))

    return best(len(ends))


def test_dynamic_programming_equals_brute_force():
    from doseloom.llm.pieces import IMBALANCE, Task, solve

    rng = np.random.default_rng(1)
    tasks, want = [], []
    for _ in range(40):
        cum = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 60))))
        at = np.unique(rng.integers(1, 60, 25))
        cost = rng.random(len(at))
        t = Task(at, cum, cost, 60, 10)
        ends = [int(x) for x in np.append(cum[t.at], cum[-1])]
        few = max(1, -(-(int(cum[-1]) - 10) // 50))
        want.append(brute_cost(ends, [int(x) for x in t.begins], [float(x) for x in t.price], 60, (int(cum[-1]) + (few - 1) * 10) / few, IMBALANCE / 3600))
        tasks.append(t)
    solve(tasks, 60)
    assert [t.value for t in tasks] == pytest.approx(want)
