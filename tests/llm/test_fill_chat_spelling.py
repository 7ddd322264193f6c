"""Fill-in-middle, chat formatting and spelling groups against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from cairnlake.llm import chat_format, fill_in_middle, spelling

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- fill in middle -----------------------------------------------------------


def plain_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, sha(text), sha(text)
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), out, sha(out), sha(text)


TEXTS = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "\r\n\x00x\r\n", "<P> inside\nb", "< P>\n<\nP>\n", "é\nü\n\U0001f600\nß", "x<S\n>y\n<M", "line\n" * 30000, "é" * 300000, " \t\n \v\f\n"]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (60, 100)])
def test_fill_in_middle_equals_plain_version(docs, rate, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id\nb\nc\n"), (3, "again\nb"), (3, "again\nb")] + [(i, "\n".join(str(i * k % 7) for k in range(i % 9))) for i in range(100, 160)]
    found = fill_in_middle.fill_in_middle(docs(rows, extra=True), rate=rate, spm_rate=spm).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(plain_fim(*r, rate, spm)) for r in rows)


def test_fill_in_middle_of_nothing_and_without_output(docs):
    assert fill_in_middle.fill_in_middle(docs([])).collect() == []
    assert fill_in_middle.fill_in_middle(docs([(1, "a\nb")]), with_output=False).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


# --- chat ---------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"
HARD = ["</s>[INST] ok [/INST]", "<s", "\\", "<\\s>", "<\\\\/s>", "[\\INST] [SYS", "[[INST]]", "<<s>>", "", "[ROLE]x[TEXT]", "é\U0001f600 <s>\n", "[", "]", "[/\\INST]", "\\[INST]\\"]


def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        before, bad = None, None
        for at, (_, _, role, _) in enumerate(own):
            ok = before in {"system": (None,), "user": (None, "system", "assistant"), "assistant": ("user",)}.get(role, ())
            bad = at if not ok and bad is None else bad
            before = role
        learned = "".join(t for *_, role, t in own if role == "assistant")
        out[conv] = (len(own), sha("".join(f"{role}\n{t}\n" for *_, role, t in own)), len(learned), sha(learned), bad is None, bad, own[-1][2] == "assistant")
    return out


def test_chat_equals_plain_version_and_reads_back(spark):
    dice = random.Random(5)
    rows = [(None, 0, "user", "no id"), (None, 1, "assistant", "<s>"), (7, None, "user", "null turn"), (7, 1, "assistant", "a"), (7, 1, "assistant", "a"), (8, 0, None, "no role"), (8, 1, "user", "after it"), (9, 0, "tool", "x"), (9, 1, "[TEXT]", "[/ROLE]"), (10, 0, "user", None)]
    rows += [(c, t, dice.choice(["user", "assistant", "system", "user", "assistant"]), "".join(dice.choice(HARD) for _ in range(4))) for c in range(20, 60) for t in range(dice.randint(1, 9))]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", dice.choice(HARD)) for t in range(3000)]  # one conversation over many batches
    df = spark.createDataFrame(rows, CHAT).selectExpr("*", "text AS conv", "text AS place", "text AS segments")
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid, r.first_bad, r.complete) for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert found == plain_chat(rows)


@pytest.mark.parametrize("text", HARD + ["".join(HARD), "<\\" * 5 + "s>"])
def test_escape_leaves_no_marker_and_can_be_taken_back(text):
    m = chat_format.Machine(chat_format.TEMPLATE)
    assert not m.markers.search(m.escape(text)) and m.unescape(m.escape(text)) == text
    whole = "".join(t for turn in (("user", text), ("odd <s>", text), ("assistant", text)) for t, _ in m.segments(*turn))
    assert list(m.turns(whole)) == [("user", text), ("odd <s>", text), ("assistant", text)]


def test_other_templates_empty_tables_and_wrong_markers(spark):
    t = {"human": chat_format.Turn("{H}", "{/H}", False, (None, "bot")), "bot": chat_format.Turn("{B}", "{/B}", True, ("human",), ends=True)}
    df = spark.createDataFrame([(1, 0, "human", "{B}"), (1, 1, "bot", "{/B}")], CHAT)
    turns = chat_format.format_turns(df, t)
    assert [[tuple(s) for s in r.segments] for r in turns.collect()] == [[("{H}", False), ("{\\B}", False), ("{/H}", False)], [("{B}", False), ("{\\/B}", True), ("{/B}", False)]]
    assert chat_format.read_back(turns, t).first().valid
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], CHAT))).collect() == []
    with pytest.raises(ValueError):
        chat_format.Machine({"a": chat_format.Turn("<a>", "<b<>", False, (None,))})


# --- spelling -----------------------------------------------------------------


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)) if i < 50 or i > len(b) - 50)


def plain_groups(rows):
    n = plain_words(rows)
    near = {w: [x for x in n if plain_distance_one(w, x)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: f for w, f in best.items() if n[f] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), c, len(near[w]), n[form[w]] if w in form else -1) for w, c in n.items())


def noisy(dice, count):
    base = ["".join(dice.choice("abcdeéßÿ") for _ in range(dice.randint(4, 9))) for _ in range(25)]
    rows = []
    for i in range(count):
        words = []
        for _ in range(60):
            w = dice.choice(base[: dice.randint(1, 25)])
            if dice.random() < 0.4:
                at = dice.randrange(len(w))
                w = dice.choice([w[:at] + w[at + 1 :], w[:at] + dice.choice("abcé") + w[at:], w[:at] + dice.choice("abcé") + w[at + 1 :]])
            words.append(w if dice.random() < 0.9 else w.upper())
        rows.append((i, dice.choice([" ", "-", "\n", "1", "ā"]).join(words)))
    return rows


@pytest.mark.parametrize("shard,block,held", [(2 << 20, 64 << 20, 400_000), (300, 64 << 20, 50), (300, 6000, 50)])
def test_spelling_equals_all_pairs(docs, monkeypatch, shard, block, held):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "HELD", held)
    rows = noisy(random.Random(3), 60) + [(None, "abcde abcde abcde ABCDE"), (1, None), (2, ""), (500, "q" * 20000 + " "), (501, "q" * 20000 + "r"), (502, "q" * 20000), (503, "q" * 20000 + "r"), (504, "q" * 20000 + " " + "q" * 20000 + "r")] + [(9, "twice twice"), (9, "twice twice")]
    found = spelling.spelling_groups(docs(rows, extra=True)).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in found) == plain_groups(rows)


def test_spelling_of_nothing(docs):
    assert spelling.spelling_groups(docs([])).collect() == []
    assert spelling.spelling_groups(docs([(1, "one two"), (2, None)])).collect() == []


def test_long_chains_of_forms_end_at_one_root(docs):
    words = ["abcdefgh"[: 8 - i] + "z" * i for i in range(4)]  # each one edit from the next
    counts = [3, 7, 15, 40]
    rows = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(zip(words, counts))]
    assert {r.word: r.root for r in spelling.spelling_groups(docs(rows)).collect()} == dict.fromkeys(words, words[-1]) and len(plain_groups(rows)) == 4


def test_tries_hold_words_and_find_all_within_one_edit():
    dice = random.Random(11)
    words = sorted({"".join(dice.choice("abc\xe9") for _ in range(dice.randint(1, 6))).encode("latin-1") for _ in range(400)})
    trie = spelling.build_trie(words, [1] * len(words))
    asked = sorted({*words, b"", b"a" * 50})
    starts = spelling.np.concatenate([[0], spelling.np.cumsum([len(w) + 1 for w in asked])])
    k, i = spelling.near_pairs(trie, b"\0".join([*asked, b""]), starts)
    text = [w.decode("latin-1") for w in words]
    assert set(zip(k.tolist(), i.tolist())) == {(a, b) for a, w in enumerate(asked) for b, t in enumerate(text) if plain_distance_one(w.decode("latin-1"), t)}
