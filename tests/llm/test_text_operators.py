"""Operators 11 to 13 against brute force: spelling variants, conversation repair, chat formatting."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import chat_format, conversations, spelling
from quire.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling", "op12_conversations", "op13_chat_format"])
def test_queries_give_the_rows_of_their_sql(name, same_rows):
    assert same_rows(QUERIES[name], SQL[name]) > 0


# --- 11


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_by_force(rows):
    counts = Counter()
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in lower).split(" "):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run if h % 97 or not run else run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = {w: [o for o in words if near(w, o)] for w in words}
    best = {w: min(o, key=lambda x: (-words[x], x)) for w, o in close.items() if o}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(close[w]), words.get(form.get(w))) for w, n in words.items())


def found_variants(df):
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def some_words(seed):
    """Words with runs of one letter and repeated bigrams, and others one or two edits from them."""
    draw = random.Random(seed)
    base = ["".join(draw.choice("aab" if i % 2 else "abcdeé") for _ in range(draw.randint(4, 12))) for i in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababababab", "bababababa"]
    out = []
    for w in base:
        out += [w] * draw.randint(3, 40)
        for _ in range(6):
            at, how, letter = draw.randrange(len(w)), draw.choice("idr"), draw.choice("abcé")
            v = w[:at] + ("" if how == "d" else letter) + w[at + (how != "i") :]
            out += [v] * draw.randint(1, 9)
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_no_near_pair_is_lost(spark, seed):
    words = some_words(seed)
    rows = [(i, " ".join(words[i::40]).title() if i % 2 else "×".join(words[i::40])) for i in range(40)]
    got = found_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got == spelling_by_force(rows)
    assert sum(r[1] is not None for r in got) > 40
    assert any(r[1] != r[2] for r in got if r[1])


def test_no_keys_are_broadcast(spark):
    """However small the words' file is, the keys made of it are not sent through the driver."""
    rows = [(i, " ".join(f"w{'abcde'[i % 5]}rd{'fghij'[j % 5]}ly" for j in range(9))) for i in range(60)]
    words = spelling.written(spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")), "words")
    for df in (spelling.near_pairs(words), spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_spelling_of_odd_documents(spark, odd_documents, plain, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    assert found_variants(odd_documents) == spelling_by_force(rows)
    assert found_variants(odd_documents.limit(0)) == []


def test_texts_are_read_in_pieces_and_words_sent_on(spark, monkeypatch):
    text = "Liegé " + "x" * 50 + " word1other " + "ß" * 7
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "PIECE", 3)
    assert spelling.runs_of(text) == whole == Counter(["liegé", "x" * 50, "word", "other", "ß" * 7])


def test_rare_bigrams_come_first(spark):
    words = spark.createDataFrame([("abcdef", 3), ("abcdeg", 3), ("abcxyz", 3), ("qrabcd", 3)], "word string, n long")
    at = defaultdict(set)
    for r in spelling.rarest(words).collect():
        at[r["word"]].add(r["p"])
    assert at["abcxyz"] == {2, 3, 4} and all(len(p) == 3 for p in at.values())


def test_one_frequent_bigram_makes_no_pairs(spark):
    """3,000 words that share all but three letters: join rows stay near the number of words."""
    words = spark.createDataFrame([(f"{''.join(p)}commonending", 3) for p in itertools.islice(itertools.permutations("abcdefghijklmnopqrst", 4), 3000)], "word string, n long")
    grams = spelling.rarest(words)
    keys = grams.select(F.explode(spelling._keys(False)).alias("key"), "word").distinct()
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] < 400


# --- 12


def repair_by_force(rows):
    """rows: (role, text, must_go, truncated). Dijkstra-like search over all edits with a bounded number of insertions."""
    best = None
    frontier = {("", 0, 0): (0, "", ())}
    form = {"": "su", "s": "u", "u": "a", "a": "u"}
    for i in range(len(rows) + 1):
        # insertions before row i
        for _ in range(3):
            for (last, at, ins), (cost, audit, out) in list(frontier.items()):
                for r in form[last].replace("s", ""):
                    key, value = (r, at, ins + 1), (cost + 3, audit + "I", (*out, {"u": "user", "a": "assistant"}[r] + ":"))
                    if ins < 3 and (key not in frontier or value[:2] < frontier[key][:2]):
                        frontier[key] = value
        if i == len(rows):
            break
        role, text, must_go, truncated = rows[i]
        after = {}
        for (last, at, _), (cost, audit, out) in frontier.items():
            options = [(last, cost + 4, audit + "D", out)]
            if not must_go:
                extra = 3 if truncated else 0
                if role[:1] and role[:1] in form[last]:
                    options.append((role[:1], cost + extra, audit + "K", (*out, f"{role}:{text}")))
                options += [(r, cost + extra + 3, audit + "R", (*out, {"u": "user", "a": "assistant"}[r] + f":{text}")) for r in form[last].replace("s", "")]
            for state, c, a, o in options:
                key = (state, at + 1, 0)
                if key not in after or (c, a) < after[key][:2]:
                    after[key] = (c, a, o)
        frontier = after
    for (last, _, _), value in frontier.items():
        if last in ("", "a") and (best is None or value[:2] < best[:2]):
            best = value
    return best


def conversation_by_force(rows):
    """conv -> REPAIRED, of the rows of the table."""
    space, by, out = " \t\n\x0b\x0c\r", defaultdict(list), []
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in by.items():
        damaged = []
        for turn, role, text in own:
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            damaged += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, edits = set(), Counter(), []
        for _, role, text in damaged:
            body = text.strip(space)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            edits.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in damaged if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(damaged))
        cost, audit, lines = repair_by_force(edits)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def some_conversations(seed, n=150):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "User"]
    texts = ["Yes.", "No!", "why?", "no end", " \t", "", None, "a b. \n", "é漢 .", "same.", "same."]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, draw.choice([turn, turn, turn, None, turn + 5, 3]), draw.choice(roles), draw.choice(texts)))
    return rows + [(n + 1, 0, "user", None)] * 3


@pytest.mark.parametrize("long", [(conversations.LONG, conversations.LONG_BYTES), (3, 1 << 30), (0, 0)])
def test_repair_is_the_cheapest_and_least(spark, long):
    rows = some_conversations(7)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("late", F.lit(1)).withColumn("part", F.lit("x")).repartition(3)
    got = sorted((tuple(r) for r in conversations.repaired(conversations.damaged(df), *long).select(*COLUMNS).collect()), key=str)
    assert got == conversation_by_force(rows)


def test_a_long_conversation_takes_blocks(spark):
    draw = random.Random(3)
    rows = [(9, i, draw.choice(["user", "assistant", "system"]), draw.choice(["a.", "b", f"{i}.", ""])) for i in range(2000)] + [(8, 0, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = conversation_by_force(rows)
    for long in (50, 5000):
        got = sorted((tuple(r) for r in conversations.repaired(conversations.damaged(df), long).select(*COLUMNS).collect()), key=str)
        assert got == want


def test_conversations_that_lose_all_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x."), (gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    want = [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    for long in (10, 0):
        assert [tuple(r) for r in conversations.repaired(conversations.damaged(df), long).select(*COLUMNS).collect()] == want
    assert conversations.repaired(conversations.damaged(df.limit(0))).collect() == []


# --- 13


def parse_by_force(text):
    """A second parser of the same grammar, character by character."""
    out, at = [], 0
    while at < len(text):
        assert text.startswith("<|im_start|>", at)
        line = text.index("\n", at)
        end = text.index("<|im_end|>\n", line)
        role = text[at + 12 : line]
        for plain, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
            role = role.replace(code, plain)
        out.append((role, text[line + 1 : end]))
        at = end + 11
    return out


TEXTS = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "plain", "", None, "<|", "<|im_start|>user\nhi<|im_end|>\n", "\\<|im_end|>\\", "<", "%0A %25 <%", "é漢🙂<|im_end|", "$1 \\1 <\\|"]


def test_every_text_comes_back(spark):
    roles = ["user", "assistant", "system", "a\nb", "<|im_end|>", "<|im_start|>", "%0A", "", None, "100%", "assistant"]
    rows = [(i % 40 if i % 41 else None, i // 40 if i % 17 else None, r, t) for i, (r, t) in enumerate(itertools.product(roles, TEXTS))] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("escape", F.lit(2))
    chats = {r["conv_id"]: r for r in chat_format.formatted(df).collect()}
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, (role or ""), (text or "")))
    digests = {r["conv_id"]: r for r in chat_format.digests(chat_format.formatted(df)).collect()}
    assert chats.keys() == own.keys() == digests.keys()
    for conv, turns in own.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        chat, source = chats[conv], [t[2:] for t in turns]
        back = parse_by_force(chat["formatted"])
        assert [r for r, _ in back] == [r for r, _ in source]
        assert all(t.count("<|im_start|>") + t.count("<|im_end|>") == 0 for _, t in back)
        d, loss = digests[conv], "".join(t for r, t in source if r == "assistant")
        assert d["n_turns"] == len(source) and d["loss_chars"] == len(loss) and d["formatted_chars"] == len(chat["formatted"])
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in source).encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_only_what_conflicts_is_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a <| b"), (1, 1, "assistant", "c <|im_end|> d"), (2, 0, "user", "50% <x>")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["formatted"] for r in chat_format.formatted(df).collect()}
    assert got[1] == "<|im_start|>user\na <| b<|im_end|>\n<|im_start|>assistant\nc <\\|im_end|> d<|im_end|>\n"
    assert got[2] == "<|im_start|>user\n50% <x><|im_end|>\n"
    assert chat_format.formatted(df.limit(0)).collect() == []


def test_what_does_not_parse_is_refused(spark):
    texts = ["", "x", "<|im_start|>user\nhi", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\na<|im_end|>b<|im_end|>\n", "<|im_start|>u\na<|im_end|>\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", chat_format.parsed(F.col("t")).alias("p")).collect()}
    assert [got[i] is None for i in range(6)] == [True] * 5 + [False]


def test_chat_formatting_is_native(spark):
    chats = chat_format.formatted(chat_format.with_tricky(spark.read.parquet(f"{SMALL}/conversations.parquet")))
    plan = chat_format.digests(chats)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "ExistingRDD", "Pandas"))
