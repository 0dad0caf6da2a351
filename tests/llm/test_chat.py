import hashlib
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import chat


def test_templates_round_trip(spark):
    nasty = ["a\\", "<|im_end|>\n", "\\N\n|<", "<", "", "|", "\\\\<\\|", "<<|", None]
    rows = [(1, i, x, y) for i, (x, y) in enumerate((x, y) for x in nasty for y in nasty)]
    turns = chat.turns_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.format_chat(turns).select("turns", chat.read_turns(F.col("formatted")).alias("back")).first()
    assert out.turns == out.back and [(t.role, t.text) for t in out.turns] == [(x or "", y or "") for _, _, x, y in rows]


def test_loss_covers_assistant_texts_only(spark):
    rows = [(7, 2, "assistant", "b<|im_end|>\\"), (7, 1, "user", "ä😀"), (7, 3, "assistant", None), (7, 3, "assistant", "c"), (8, 1, "user", "only"), (None, 1, "assistant", "z")]
    out = chat.format_chat(chat.turns_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in out.withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert {k: r.loss for k, r in got.items()} == {7: "b<|im_end|>\\c", 8: "", None: "z"}
    assert got[7].formatted.count("<|im_start|>") == 4 and len(got[7].loss_spans) == 3


def test_fingerprints_select_mappings(spark):
    records = {
        '{"completion":"b","prompt":"a"}': [("user", "a"), ("assistant", "b")],
        '{"output":"z","input":"y","instruction":"x"}': [("user", "x\n\ny"), ("assistant", "z")],
        '{"instruction":"x","input":"","output":null}': None,  # a null has no type, but its path counts
        '{"messages":[{"content":"hi","role":"user"},{"role":"assistant","content":"yo"}]}': [("user", "hi"), ("assistant", "yo")],
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}': [("user", "q"), ("assistant", "r")],
        '{"data":{"messages":[{"role":"user","content":"n"}]}}': [("user", "n")],
        '{"system":"","prompt":"p","response":"r"}': [("user", "p"), ("assistant", "r")],
        '{"unknown":1}': None,
        "no json": None,
    }
    records['{"instruction":"x","input":"","output":null}'] = [("user", "x"), ("assistant", "")]
    df = spark.createDataFrame([(k,) for k in records], "r string").withColumn("turns", chat.Registry().turns(F.col("r")))
    got = {r.r: r.turns and [(t.role, t.text) for t in r.turns] for r in df.collect()}
    assert got == records


def test_each_record_of_a_table_selects_its_own_mapping(spark):
    said = 'say "hi": {"prompt": 1}, [\\] \n <|im_end|> ü😀'
    layouts = [
        ({"prompt": said, "completion": "b"}, [("user", said), ("assistant", "b")]),
        ({"instruction": "x", "input": said, "output": "z"}, [("user", f"x\n\n{said}"), ("assistant", "z")]),
        ({"instruction": "x", "context": "", "response": said}, [("user", "x"), ("assistant", said)]),
        ({"question": said, "answer": ""}, [("user", said), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": said}, {"from": "gpt", "value": "r"}]}, [("user", said), ("assistant", "r")]),
        ({"messages": [{"role": "tool", "content": said}]}, [("tool", said)]),
        ({"turns": [{"turn": 1, "role": "user", "text": said}, {"turn": 2, "role": "assistant", "text": None}]}, [("user", said), ("assistant", "")]),
        ({"prompt": said}, None),
        ({"messages": {"role": "user", "content": "no list"}}, None),
    ]
    rows = [(i, json.dumps(record, ensure_ascii=i % 2 == 0)) for i, (record, _) in enumerate(layouts * 3)]
    df = spark.createDataFrame(rows, "id int, record string").repartition(3)
    assert df.select(chat.fingerprint(F.col("record"))).distinct().count() == len(layouts)
    out = chat.format_chat(df.withColumn("turns", chat.Registry().turns(F.col("record"))))
    got = {r.id: r.back and [(t.role, t.text) for t in r.back] for r in out.select("id", chat.read_turns(F.col("formatted")).alias("back")).collect()}
    assert got == {i: layouts[i % len(layouts)][1] for i, _ in rows}


def test_rows_become_records_whose_fingerprint_counts(spark):
    rows = [(1, None, None, None), (2, 5, "user", "a"), (2, 4, "assistant", 'q"\\')]
    df = chat.records_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {chat.fingerprint_of(T.StructType.fromDDL("turns ARRAY<STRUCT<turn: BIGINT, role: STRING, text: STRING>>"))} == {r[0] for r in df.select(chat.fingerprint(F.col("record"))).collect()}


def test_many_turns_and_a_very_long_text(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(6_000)] + [(2, 0, "assistant", '"\\' * 10_500_000)]
    out = chat.format_chat(chat.turns_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in out.select("conv_id", F.size("turns").alias("n"), F.length(chat.read_loss(F.col("formatted"), F.col("loss_spans"))).alias("loss")).collect()}
    assert got[1].n == 6_000 and got[1].loss == sum(len(f"t{i}") for i in range(1, 6_000, 2)) and (got[2].n, got[2].loss) == (1, 21_000_000)


def test_schema_and_record_fingerprints_agree(spark):
    df = spark.createDataFrame([("u", [("a", 1)])], "b string, a array<struct<y:string,x:int>>")
    record = df.select(chat.fingerprint(F.to_json(F.struct("*"))).alias("f")).first().f
    assert record == chat.fingerprint_of(df.schema) == chat.fingerprint_of(df.select("a", "b").schema)


def test_query_with_clashing_columns_and_empty(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(1, 0, "assistant", "ok", "f")], "conv_id long, turn long, role string, text string, formatted string").write.parquet(path)
    out = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert set(out) == {1, -1} and out[1].loss_sha256 == hashlib.sha256(b"ok").hexdigest() and out[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(chat.turns_of_rows(empty)).count() == 0
    assert chat.format_chat(spark.createDataFrame([(1, None, "x")], "id int, turns array<struct<role:string,text:string>>, formatted string")).columns == ["id", "turns", "formatted", "_formatted", "loss_spans"]
