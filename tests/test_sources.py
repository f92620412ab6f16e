import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions import pure
from cloakframe.functions.keys import Key
from cloakframe.plans.compiler import Engine
from cloakframe.plans.policy import STRICT, Policy, metadata
from cloakframe.plans.vocab import Declaration, Keep
from cloakframe.ship import ship
from cloakframe.sources import dberrors
from cloakframe.sources.jsonio import mask_json, masks_names
from cloakframe.sources.logs import fill, mask_events
from cloakframe.sources.records import Settings, mask_records, split_failures
from cloakframe.streaming.masking import mask_stream, tokens_with_ttl, write_events, write_masked

KEY = Key.of_secret("a secret that is long enough")
ENGINE = Engine(key=KEY)
MAIL, MASKED = "john.doe@example.com", "j*******@e******.com"


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_json(spark):
    text = json.dumps({"a": MAIL, MAIL: [1, {"b": f"to {MAIL}"}], "n": 4111111111111111, "t": None})
    assert json.loads(one(spark, text, lambda c: mask_json(c, STRICT, KEY))) == {"a": MASKED, MASKED: [1, {"b": f"to {MASKED}"}], "n": 4111111111111111, "t": None}
    assert one(spark, f'{{"a": "{MAIL}"', lambda c: mask_json(c, STRICT, KEY)) == '"****"'
    assert one(spark, '{"k": 87}', lambda c: mask_json(c, STRICT, KEY)) == '{"k": 87}'
    assert one(spark, None, lambda c: mask_json(c, STRICT, KEY)) is None
    exact = '{ "n": 1.10, "n" : 12345678901234567890.123456, "e":1e5, "s": "to %s", "u": "\\u0041\\/" }' % MAIL
    assert one(spark, exact, lambda c: mask_json(c, STRICT, KEY)) == exact.replace(MAIL, MASKED)
    assert json.loads(one(spark, '{"a": "john.doe\\u0040example.com"}', lambda c: mask_json(c, STRICT, KEY))) == {"a": MASKED}
    plain = Policy(scan_text=False, mask_keys=False)
    assert not masks_names(plain) and list(json.loads(one(spark, text, lambda c: mask_json(c, plain, KEY))))[1] == MAIL


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (dberrors.key_values, "Key (email)=(x) already exists.", "Key (email)=(****) already exists."),
        (dberrors.key_values, "Key (a, b)=(1,\n(2)) is", "Key (a, b)=(****) is"),
        (dberrors.detail, "Failing row contains (1, secret).", None),
        (dberrors.detail, "", ""),
        (dberrors.primary, f"bad {MAIL}", f"bad {MASKED}"),
        (dberrors.where, 'COPY t, line 1: "secret"', 'COPY t, line 1: "****"'),
        (dberrors.primary_quoted, "Duplicate entry 'Kim-4711' for key 'orders.orders_ref_key'", "Duplicate entry '****' for key 'orders.orders_ref_key'"),
        (dberrors.primary_quoted, "it's 'a' and 'b c' and don't", "it'****'a'****'b c'****'t"),
        (dberrors.primary_quoted, "only 'name'", "only 'name'"),
        (dberrors.primary_quoted, "value 'a b' is long", "value '****' is long"),
        (dberrors.primary_quoted, "in \"select 'name' from\"", "in \"select '****' from\""),
    ],
)
def test_database_texts(spark, f, text, want):
    assert one(spark, text, lambda c: f(c, STRICT) if f is dberrors.key_values else f(c, STRICT, KEY)) == want


def test_quoted_values_natively(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["'", "'", '"', "a", "b.c", " ", "9", "\n", "é"], k=rng.randrange(0, 14))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(dberrors.unquoted(F.col("t"), STRICT).alias("u")).collect()
    assert [r.u for r in rows] == [dberrors.without_quoted_values(t, "****") for t in texts]


def test_chains(spark):
    links = [f"cause: {MAIL}", "Key (a)=(secret one) exists", "Duplicate entry 'x y'", "near 'x y'", None] + ["more"] * 13
    states = [None, "23505", "23000", "42000", None] + [None] * 13
    rows = spark.createDataFrame([(links, states), (["fine"], ["08000"]), (None, None)], "m array<string>, s array<string>")
    got = [r.c for r in rows.select(dberrors.chain(F.col("m"), STRICT, KEY, F.col("s")).alias("c")).collect()]
    assert got[0] == [f"cause: {MASKED}", "Key (a)=(****) exists", "Duplicate entry '****'", "near 'x y'", None] + ["more"] * 11 + ["****"] * 2
    assert got[1:] == [["fine"], None]


def test_database_errors(spark):
    names = ["severity", "sqlstate", "schema", "table", "column", "constraint", "message", "detail", "hint", "where", "internal_query"]
    rows = [("ERROR", "23505", "s", "t", "c", "k", "Duplicate entry 'a b'", "Key (e)=(x) exists.", MAIL, None, "select 'x'"), ("ERROR", "42601", None, None, None, None, "near 'a b'", None, None, None, None)]
    got = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names])).select(*dberrors.sanitized(STRICT, KEY)).collect()
    assert (got[0].message, got[0].detail, got[0].hint, got[0].internal_query, got[0].error_class, got[0].table) == ("Duplicate entry '****'", "Key (e)=(****) exists.", MASKED, None, "IntegrityConstraintViolation", "t")
    assert (got[1].message, got[1].error_class) == ("near 'a b'", "SyntaxError")
    with pytest.raises(dberrors.SanitizedError) as e:
        dberrors.guarded(lambda: (_ for _ in ()).throw(RuntimeError(f"Key (a)=(x) {MAIL}")))
    assert "x" not in str(e.value).split("=")[1][:4] and MAIL not in str(e.value) and e.value.__cause__ is None


def test_parameters(spark):
    assert [one(spark, t, lambda c: dberrors.parameter(c, "string", STRICT, KEY)) for t in (MAIL, "text", None)] == [MASKED, "****", "null"]
    r = spark.createDataFrame([(bytearray(b"abc"), 5, None)], "b binary, n int, d date").select(*[dberrors.parameter(F.col(c), k).alias(c) for c, k in (("b", "binary"), ("n", "int"), ("d", "date"))]).first()
    assert tuple(r) == ("<byte[3]>", "<int>", "null")


def test_log_events(spark):
    assert fill("a {} b \\{} {}", ["1", None, "3"]) == "a 1 b {} null" and fill("{}", []) == "{}" and fill("x", ["1"]) == "x"
    schema = "template string, args array<string>, mdc map<string,string>, kv array<struct<key:string,value:string>>, thrown array<struct<class_name:string,message:string,stack:array<string>>>, markers array<struct<name:string,payload:string>>, logger string"
    rows = [("to {} now", [MAIL], {"user": MAIL}, [("k", MAIL)], [("a.B", f"for {MAIL}", ["x"]), ("c.D", None, None)], [(MAIL, MAIL)], MAIL), ("split 4111{}", ["111111111111"], None, None, None, None, None), (None,) * 7]
    got = mask_events(spark.createDataFrame(rows, schema), ENGINE).collect()
    a = got[0]
    assert (a.message, a.args, a.mdc, a.kv[0].value, a.logger) == (f"to {MASKED} now", [MASKED], {"user": MASKED}, MASKED, MAIL)
    assert [(t.class_name, t.message) for t in a.thrown] == [("a.B", f"for {MASKED}"), ("c.D", None)]
    assert (a.markers[0].name, a.markers[0].payload) == (MAIL, MASKED)
    assert got[1].message == "split **** **** **** 1111" and got[2].message is None


def records(spark):
    head = [("Auth", bytearray(b"abc")), ("mail", bytearray(MAIL.encode())), ("bin", bytearray(b"\xff\xfe")), ("none", None)]
    schema = "key binary, value binary, headers array<struct<key:string,value:binary>>, topic string, offset long"
    value = json.dumps({"email": MAIL, "iban": "CH9300762011623852957", "cents": 5})
    return spark.createDataFrame([(bytearray(MAIL.encode()), bytearray(value.encode()), head, "t", 1), (None, None, None, "t", 2)], schema)


def test_records(spark):
    out = mask_records(records(spark), ENGINE, Settings.of({"mask.keys": "TRUE", "headers.redact": "x, AUTH"})).orderBy("offset").collect()
    assert bytes(out[0].key).decode() == MASKED and MASKED in bytes(out[0].value).decode() and MAIL not in bytes(out[0].value).decode()
    assert [None if h.value is None else bytes(h.value) for h in out[0].headers] == [b"****", MASKED.encode(), b"\xff\xfe", None]
    assert (out[1].key, out[1].value, out[1].headers, out[1].topic) == (None, None, None, "t")
    untouched = mask_records(records(spark), ENGINE).orderBy("offset").first()
    assert bytes(untouched.key).decode() == MAIL and bytes(untouched.headers[0].value) == b"abc"


def test_structured_records(spark):
    s = T.StringType()
    schema = T.StructType([T.StructField("email", s, True, metadata(Declaration("EMAIL"))), T.StructField("iban", s, True, metadata(Declaration("IBAN"))), T.StructField("cents", T.LongType(), True, metadata(Keep("an amount in a test")))])
    out = mask_records(records(spark), ENGINE, value_schema=schema).orderBy("offset").collect()
    assert json.loads(bytes(out[0].value)) == {"email": MASKED, "iban": "CH93 **** **** **** *295 7", "cents": 5}
    assert out[1].value is None and out[1].offset == 2


def structured(spark, *values):
    return spark.createDataFrame([(None if v is None else bytearray(v if isinstance(v, bytes) else v.encode()), k) for k, v in enumerate(values)], "value binary, offset int")


SCHEMA = T.StructType(
    [
        T.StructField("email", T.StringType(), True, metadata(Declaration("EMAIL"))),
        T.StructField("amount", T.DoubleType(), True, metadata(Keep("an amount in a test"))),
        T.StructField("who", T.StructType([T.StructField("name", T.StringType(), True, metadata(Declaration("FULL_NAME")))])),
        T.StructField("cards", T.ArrayType(T.StructType([T.StructField("pan", T.StringType(), True, metadata(Declaration("PAN")))]))),
    ]
)


def test_undeclared_properties_stay(spark):
    sent = '{"email":"%s","amount":1.10,"who":{"name":"Jane Roe","note":"to %s","n":1.50},"cards":[{"pan":"4111111111111111","x":null},{"pan":null}],"free":"to %s","none":null,"big":12345678901234567890.5,"deep":[{"%s":"%s"}]}' % (MAIL, MAIL, MAIL, MAIL, MAIL)
    want = '{"email":"%s","amount":1.10,"who":{"name":"J*** R**","note":"to %s","n":1.50},"cards":[{"pan":"**** **** **** 1111","x":null},{"pan":null}],"free":"to %s","none":null,"big":12345678901234567890.5,"deep":[{"%s":"%s"}]}' % (MASKED, MASKED, MASKED, MASKED, MASKED)
    out = mask_records(structured(spark, sent, "{}", '{"email":null}'), ENGINE, value_schema=SCHEMA).orderBy("offset").collect()
    assert [bytes(r.value).decode() for r in out] == [want, "{}", '{"email":null}']


def test_failures_are_withheld(spark):
    rows = structured(spark, '{"email":"%s"}' % MAIL, "{broken " + MAIL, MAIL, "[1]", None, b"\xff\xfe", "")
    assert {r.offset for r in mask_records(rows, ENGINE, value_schema=SCHEMA).collect()} == {0, 4}
    good, bad = split_failures(mask_records(rows, ENGINE, value_schema=SCHEMA, failed="failed"))
    assert {r.offset: r.value and bytes(r.value).decode() for r in good.collect()} == {0: '{"email":"%s"}' % MASKED, 4: None}
    assert bad.columns == ["offset"] and {r.offset for r in bad.collect()} == {1, 2, 3, 5, 6}
    assert {r.offset for r in mask_records(rows, ENGINE).collect()} == {0, 1, 2, 3, 4, 6}
    with pytest.raises(Exception, match="could not be masked") as e:
        mask_records(rows, Engine(Policy(failure="THROW"), KEY), value_schema=SCHEMA).collect()
    assert MAIL not in str(e.value)


def test_record_settings(spark):
    own = Engine(key=KEY).detector(pure.detector("employee", "CREDENTIAL", r"EMP-\d+"))
    out = mask_records(structured(spark, "of EMP-12 and " + MAIL), own).first()
    assert bytes(out.value).decode() == f"of **** and {MASKED}"
    own.install()
    text = '{"n": 4111111111111111, "s": "EMP-77"}'
    out = mask_records(structured(spark, text), None, Settings.of({"value.format": "JSON"})).first()
    assert bytes(out.value).decode() == text.replace("EMP-77", "****")
    with pytest.raises(ValueError):
        Settings.of({"key.format": "avro"})


def test_streams(spark, tmp_path):
    records(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(records(spark).schema).parquet(f"{tmp_path}/in")
    assert mask_stream(stream, ENGINE).isStreaming
    q = write_masked(stream, ENGINE, f"{tmp_path}/out", f"{tmp_path}/withheld", f"{tmp_path}/cp")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("offset").collect()
    assert MASKED in bytes(got[0].value).decode() and got[1].value is None
    assert spark.read.parquet(f"{tmp_path}/withheld").count() == 0 and got[0].batch == 0


def test_streamed_failures_and_a_batch_that_runs_again(spark, tmp_path):
    structured(spark, '{"email":"%s"}' % MAIL, "{broken").write.parquet(f"{tmp_path}/in")
    for again in ("a", "b"):  # another checkpoint, so the first batch runs once more into the same place
        stream = spark.readStream.schema("value binary, offset int").parquet(f"{tmp_path}/in")
        write_masked(stream, ENGINE, f"{tmp_path}/out", f"{tmp_path}/withheld", f"{tmp_path}/cp-{again}", value_schema=SCHEMA).awaitTermination()
    assert [bytes(r.value).decode() for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ['{"email":"%s"}' % MASKED]
    assert [(r.offset, r.batch) for r in spark.read.parquet(f"{tmp_path}/withheld").collect()] == [(1, 0)]


def test_streamed_events(spark, tmp_path):
    spark.createDataFrame([("to {}", [MAIL])], "template string, args array<string>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("template string, args array<string>").parquet(f"{tmp_path}/in")
    write_events(stream, ENGINE, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").first().message == f"to {MASKED}"


def test_stream_tokens(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("v string").parquet(f"{tmp_path}/in")
    q = tokens_with_ttl(stream, "v", "EMAIL").writeStream.format("memory").queryName("tokens").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    # Timeouts keep such a query running, so it's stopped when the rows are there.
    until = time.time() + 90
    while spark.table("tokens").count() < 2 and time.time() < until:
        time.sleep(0.5)
    q.stop()
    got = {r.value: r.token for r in spark.table("tokens").collect()}
    assert set(got) == {"a", "b"} and got["a"] != got["b"] and got["a"].startswith("tok_email_")
