import hashlib
import random

import public_tokenizers as P

from kadence.llm import chat_windows as cw
from tests.llm.samples import LONG, prose

RANKS = P.path("byte_bpe_50k.tiktoken")
HARD = r"\### Assistant: </turn> ok <again>\l \\n <turn>assistant"


def windows_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'x' as conv_", "1L as window", "'y' as loss")
    return cw.format_windows(df, "conv_id", "turn", "role", "text", RANKS, P.PATTERN, **options)


def conversation(conv, n, seed):
    draw = random.Random(seed)
    rows = [(conv, 0, "system", f"rules {seed}")]
    return rows + [(conv, k, "assistant" if k % 2 == 0 else "user", prose(seed * 100 + k, draw.randrange(1, 60))) for k in range(1, n)]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_escaping_is_undone():
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choice("\\<>lnt\n/a") for _ in range(draw.randrange(20)))
        assert cw.unescape(cw.escape(text)) == text and "<" not in cw.escape(text)
        assert cw.unescape(cw.escape_role(text)) == text and "\n" not in cw.escape_role(text)


ROWS = [
    *conversation(1, 30, 1),
    *conversation(2, 2, 2),
    (-7, 0, "user", HARD),
    (-7, 1, "assistant", HARD),
    (3, 0, "system", "only rules"),
    (4, 5, "assistant", "tie"),
    (4, 5, "assistant", "tie"),
    (4, None, None, None),
    (4, 2, "odd\n<role>", "x"),
    (5, 0, "user", LONG),
    (5, 1, "assistant", ""),
    (6, 0, "assistant", "answers first"),
    (6, 1, "system", "late rules"),
    (None, 0, "assistant", "no conversation"),
]


def test_reads_back_as_it_was(spark):
    windows = windows_of(spark, ROWS, budget=200, history=60)
    back = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cw.read_back(windows, "conv_id").collect()}
    assert back == brute(ROWS)


def test_windows_keep_to_the_budget(spark):
    rows = windows_of(spark, ROWS, budget=200, history=60).collect()
    mine = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.window)
    assert len(mine) > 3 and all(r.n_tokens <= 200 for r in mine)
    assert all(r.text.split("\n", 1)[0].endswith("system") and "rules 1" in r.text for r in mine)
    assert not mine[0].n_repeated and all(r.n_repeated >= 1 for r in mine[1:])
    assert any(r.n_repeated > 1 for r in mine[1:])
    for before, after in zip(mine, mine[1:], strict=False):
        repeated = [t for t in after.text.split("</turn>\n") if t.startswith("<again>")][1:]
        if not repeated:
            continue
        assert [t.split("\n", 1)[1] for t in repeated] == [t.split("\n", 1)[1] for t in before.text.split("</turn>\n")[:-1]][-len(repeated) :]
    long = [r for r in rows if r.conv_id == 5]
    assert any(r.n_tokens > 200 and r.n_turns == 1 for r in long)
    assert sum(len(r.loss) for r in rows if r.conv_id == 1) == sum(r[0] == 1 and r[2] == "assistant" for r in ROWS)


def test_long_runs(spark):
    rows = [(1, k, "assistant", c * 2_000_000 + e) for k, (c, e) in enumerate([(" ", ""), ("\n", "x"), ("\t", " y"), ("a", ""), ("7", "")])]
    back = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cw.read_back(windows_of(spark, rows), "conv_id").collect()}
    assert back == brute(rows)


def test_empty_table(spark):
    windows = windows_of(spark, [])
    assert windows.count() == 0 and cw.read_back(windows, "conv_id").count() == 0
