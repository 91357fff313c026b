from pyspark.sql import functions as F

from cueloom.llm.preferences import conversation_pairs, format_pairs

U, A = "user", "assistant"


def brute(chosen, rejected):
    chosen, rejected = chosen or [], rejected or []
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def safe(s):
        return (s or "").replace("<|", "< |")

    def show(turns):
        out, spans = "", []
        for role, text in turns:
            head, body = f"<|im_start|>{safe(role)}\n", f"{safe(text)}<|im_end|>\n"
            if role == A:
                spans.append((len(out) + len(head), len(out) + len(head) + len(body)))
            out += head + body
        return out, spans

    (c, cm), (r, rm) = show(chosen[n:]), show(rejected[n:])
    both = bool(chosen[n:]) and bool(rejected[n:]) and chosen[n][0] == A and rejected[n][0] == A
    return n, show(chosen[:n])[0], c, r, cm, rm, bool(chosen) and bool(rejected), both


CASES = [
    ([(U, "hi"), (A, "yes")], [(U, "hi"), (A, "no"), (U, "x"), (A, "y 😀")]),
    ([(U, "hi"), (A, "yes")], [(U, "hi"), (A, "yes")]),
    ([(U, "hi")], [(A, "hi")]),
    ([], [(U, "a")]),
    (None, None),
    ([(None, None), (A, "a<|im_end|>b")], [(None, None), (A, "é" * 5000)]),
    ([(U, "same"), (A, "p")], [(U, "same")]),
]


def test_matches_brute_force(spark):
    table = spark.createDataFrame([(i, *c, "z") for i, c in enumerate(CASES)], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt_id string")
    for row in format_pairs(table).collect():
        got = (row["n_common"], row["prompt"], row["chosen"], row["rejected"], [tuple(s) for s in row["chosen_mask"]], [tuple(s) for s in row["rejected_mask"]], row["paired"], row["comparable"])
        assert got == brute(*CASES[row["pair_id"]]), row["pair_id"]


def test_pairs_of_conversations(spark):
    turns = [(0, 1, A, "b"), (0, 0, U, "a"), (1, 0, U, "a"), (1, 1, A, "c"), (4, 0, U, "z"), (None, 0, U, "q"), (0, 1, A, "b")]
    pairs = conversation_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    found = {r["pair_id"]: ([tuple(t) for t in r["chosen"]], [tuple(t) for t in r["rejected"]]) for r in pairs.collect()}
    assert found == {0: ([(U, "a"), (A, "b"), (A, "b")], [(U, "a"), (A, "c")]), 2: ([(U, "z")], [])}
    assert format_pairs(pairs.where(F.lit(False))).count() == 0


def test_plan_has_no_python(spark):
    turns = spark.createDataFrame([(0, 0, U, "a")], "conv_id long, turn long, role string, text string")
    plan = format_pairs(conversation_pairs(turns))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_large_negative_and_null_ids_pair_up(spark):
    big = 1 << 60
    rows = [(c, 1, "user", "u", 5) for c in [*range(big, big + 6), -4, -3, None]]
    pairs = conversation_pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, extra int"))
    assert {r["pair_id"]: (len(r["chosen"]), len(r["rejected"])) for r in pairs.collect()} == {big // 2: (1, 1), big // 2 + 1: (1, 1), big // 2 + 2: (1, 1), -2: (1, 1)}


def test_clashing_columns_pass_through(spark):
    turns = "array<struct<role:string,text:string>>"
    schema = f"pair_id long, chosen {turns}, rejected {turns}, prompt string, _c int, left int, n int, `odd name` int"
    out = format_pairs(spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")], None, "mine", 7, 8, 9, 10)], schema))
    assert out.columns == ["pair_id", "prompt", "_c", "left", "n", "odd name", "n_common", "_prompt", "chosen", "rejected", "chosen_mask", "rejected_mask", "paired", "comparable"]
    r = out.collect()[0]
    assert (r["prompt"], r["_c"], r["left"], r["n"], r["odd name"], r["_prompt"], r["paired"], r["n_common"]) == ("mine", 7, 8, 9, 10, "", False, 0)
