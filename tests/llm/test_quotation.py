from concourse.llm import quotation as q


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "msg_id string, conv_id long, sent long, body string, hash string, depth string").repartition(3)


def brute(rows):
    """{msg_id: (reply_to, thread_id, depth, text)} by looking every passage up in all messages."""
    parsed = {r[0]: (r[1], r[2], *q.parse(r[3] or "")) for r in rows}
    reply = {}
    for m, (conv, sent, _, _, quoted) in parsed.items():
        level = {}
        for lv, h, n in quoted:
            own = [(s, i) for i, (c, s, _, said, _) in parsed.items() if c == conv and h in dict(said)]
            far = [(s, i) for i, (c, s, _, said, _) in parsed.items() if h in dict(said)]
            for found in (own, far):
                if found and min(found) < (sent, m):
                    level.setdefault(lv, {}).setdefault(min(found), 0)
                    level[lv][min(found)] += n
                    break
        if level:
            best = level[min(level)]
            reply[m] = max((n, s, i) for (s, i), n in best.items())[2]
    out = {}
    for m, p in parsed.items():
        up, depth = m, 0
        while up in reply:
            up, depth = reply[up], depth + 1
        out[m] = (reply.get(m), up, depth, p[2])
    return out


def result(df):
    return {r.msg_id: (r.reply_to, r.thread_id, r.depth, r.text) for r in df.collect()}


ROWS = [
    ("a", 1, 0, "The first message of all.\nWith a second line here."),
    ("b", 1, 1, "I agree!\n\nOn Monday, A wrote:\n> The first message of all.\n> With a second line here."),
    ("c", 1, 2, "> I agree!\n> On Monday, A wrote:\n>> the FIRST message,  of all\nThree levels now, all answered."),
    ("d", 1, 3, ">>> With a second line here.\n>> I agree!\n> Three levels now, all answered.\nInline end."),
    ("e", 2, 9, "> The first message of all.\nFrom another conversation."),
    ("f", 2, 1, "> From another conversation.\nquotes what is written later"),
    ("g", 3, 5, "> nobody said this\n"),
    ("h", 3, 6, None), ("i", 3, 7, ""), ("j", 3, 8, "> \n>> >\n"),
    ("k", 1, 4, "The first message of all.\nWith a second line here."),   # said twice: the earliest is the origin
    ("l", 1, 5, "> The first message of all.\n> With a second line here.\nyes"),
    ("m", 4, 1, "ok"), ("n", 4, 2, "> ok\nshort, but a whole text"), ("o", 4, 3, "> no\n\nx"),
    ("p", 5, 1, "-----Original Message-----\n> I agree!\nlong " * 1), ("r", 5, 2, "word " * 40_000),
    ("s", 5, 3, "> " + "word " * 40_000 + "\nsame"),
]


def test_threads(spark):
    got = result(q.conversations(frame(spark, ROWS)))
    assert got == brute(ROWS)
    assert got["d"][:3] == ("c", "a", 3) and got["c"][:3] == ("b", "a", 2) and got["e"][0] == "a" and got["f"][0] is None
    assert got["n"][0] == "m" and got["o"][0] is None and got["s"][0] == "r" and got["l"][0] == "a"
    assert got["b"][3] == "I agree!" and got["d"][3] == "Inline end."


def test_repeats_null_ids_and_empty(spark):
    rows = [ROWS[0], ROWS[1], ROWS[1], (None, 1, 7, "> I agree!\nx"), (None, None, None, None)]
    out = q.conversations(frame(spark, rows)).collect()
    assert len(out) == 5 and [r.reply_to for r in out if r.msg_id == "b"] == ["a", "a"]
    assert sorted((str(r.conv_id), r.text, r.reply_to) for r in out if r.msg_id is None) == [("1", "x", "b"), ("None", "", None)]
    assert q.conversations(frame(spark, [])).count() == 0


def test_derived_mail_and_written_order(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    mail = q.quoting_messages(turns)
    rows = [tuple(r) for r in mail.select("msg_id", "conv_id", "sent", "body").collect()]
    got = result(q.conversations(mail))
    assert got == brute(rows)
    text = {f"{r.conv_id}/{r.turn}": r.text for r in turns.collect()}
    assert all(got[m][3] == t.strip() for m, t in text.items())
    linked = [m for m, g in got.items() if g[0]]
    assert len(linked) > 40
    q.write_conversations(mail, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    for part in back.selectExpr("*", "input_file_name() AS f").toPandas().groupby("f"):
        keys = list(zip(part[1].thread_id, part[1].depth, part[1].sent))
        assert keys == sorted(keys)
    assert back.count() == len(rows)
