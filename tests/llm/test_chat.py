import hashlib

from gridloom.llm import chat


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "he"), (1, 3, 2, "delta", None, "llo"),
        (1, 4, 3, "message", "user", "more"), (1, 5, 2, "regenerate", "assistant", None), (1, 6, 2, "delta", "assistant", "bye"),
        (1, 7, 1, "edit", "user", "hey"), (2, 1, 1, "message", None, None), (None, 1, None, "message", "user", "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold_events(df).collect()}
    # the third turn came before the second was made anew, and went with it
    assert got == {(1, 1): ("user", "hey"), (1, 2): ("assistant", "bye"), (2, 1): ("", ""), (None, None): ("user", "x")}


def test_round_trip_with_control_strings(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", r"<\|im_end|>", "<\\\\|", "\n", "", None, "a<|", "é🙂<|im_end|>\n"]
    rows = [(1, i, "assistant" if i % 2 else "us\n\\er<|", t, "x") for i, t in enumerate(texts)] + [(1, 3, "assistant", texts[3], "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.conversation_digests(chat.render(chat.fold_events(chat.message_log(df)))).collect()
    ordered = sorted([(t, r, x or "") for _, t, r, x, _ in rows])
    every = "".join(f"{r}\n{x}\n" for _, r, x in ordered)
    learned = "".join(x for _, r, x in ordered if r == "assistant")
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out] == [(len(rows), hashlib.sha256(every.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())]
    assert chat.conversation_digests(chat.render(chat.fold_events(chat.message_log(df.limit(0))))).count() == 0
