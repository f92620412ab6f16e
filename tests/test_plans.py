import json
import time
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions import pure
from cloakframe.functions.keys import Key
from cloakframe.operators.observe import counters, decided, findings_by, observed, report
from cloakframe.operators.vault import Vault
from cloakframe.plans.compiler import Engine, from_settings, installed, mask, serialise
from cloakframe.plans.lint import lint
from cloakframe.plans.policy import RELAXED, STRICT, MaskingFailed, MissingSecret, Overrides, Policy, from_conf, metadata
from cloakframe.plans.vocab import Declaration, Drop, Keep
from cloakframe.ship import ship

KEY = Key.of_secret("a secret that is long enough")
ENGINE = Engine(key=KEY)
MAIL = "john.doe@example.com"
MASKED = "j*******@e******.com"


def field(name, dtype, what=None, **more):
    return T.StructField(name, dtype, True, (metadata(what) if what else {}) | more)


def test_a_whole_record(spark):
    s = T.StringType()
    card = T.StructType([field("number", s, Declaration("PAN")), field("cvv", s, Declaration("CARD_VERIFICATION_VALUE", keep=3)), field("holder", s, Declaration("FULL_NAME"))])
    schema = T.StructType(
        [
            field("reference", s),
            field("email", T.StructType([field("value", s)]), Declaration("EMAIL")),
            field("balance", T.DecimalType(38, 18), Declaration("FINANCIAL_AMOUNT")),
            field("currency", s, Keep("public")),
            field("born", T.DateType(), Declaration("DATE_OF_BIRTH")),
            field("seen", T.TimestampType(), Declaration(strategy="DATE_GENERALIZE")),
            field("note", s, Declaration("FREEFORM_TEXT")),
            field("cards", T.MapType(s, card)),
            field("tags", T.ArrayType(s)),
            field("deep", T.ArrayType(T.ArrayType(T.StructType([field("t", s)])))),
            field("count", T.IntegerType(), Declaration("CUSTOMER_ID")),
            field("flag", T.BooleanType(), Declaration()),
            field("list", T.ArrayType(s), Declaration("EMAIL")),
            field("id", s, kind="leaf"),
            field("gone", s, Drop()),
            field("format", s, Declaration(strategy="PRESERVE_FORMAT")),
            field("raw", T.BinaryType(), Declaration()),
        ]
    )
    row = (f"to {MAIL}", (MAIL,), Decimal("12345.67"), "CHF", date(1985, 3, 17), datetime(2024, 5, 6, 7), f"call {MAIL}", {MAIL: ("4111111111111111", "123", "John Doe")}, [MAIL, None, "x"], [[(f"a {MAIL}",)], []], 7, True, [MAIL], MAIL, "secret", "AB-12", b"x")
    df = spark.createDataFrame([row, (None,) * len(row)], schema)
    out = mask(df, ENGINE)
    assert out.dtypes == df.dtypes
    r, none = out.collect()
    assert (r.reference, r.email.value, r.balance, r.currency, r.born, r.seen, r.note) == (f"to {MASKED}", MASKED, 0, "CHF", date(1985, 1, 1), datetime(2024, 1, 1), f"call {MASKED}")
    ((k, card),) = r.cards.items()
    assert (k, tuple(card)) == (MASKED, ("**** **** **** 1111", "****", "J*** D**"))
    assert (r.tags, r.deep[0][0].t, r.deep[1]) == ([MASKED, None, "x"], f"a {MASKED}", [])
    assert (r["count"], r.flag, r.list, r.id, r.gone, r.raw) == (0, False, None, MAIL, None, None)
    assert r.format != "AB-12" and len(r.format) == 5 and r.format[2] == "-"
    assert all(v is None for v in none)
    assert "gone" not in mask(df, ENGINE, drop=True).columns
    wide = mask(df.select("list"), Engine(key=KEY, element_wise=True)).first()
    assert wide.list == [MASKED]


def test_untouched_columns_are_bare(spark):
    df = spark.range(3).withColumn("s", F.struct(F.col("id").alias("a")))
    assert "CASE" not in mask(df, ENGINE)._jdf.queryExecution().optimizedPlan().toString()
    relaxed = mask(spark.createDataFrame([(MAIL,)], "t string"), Engine(RELAXED, KEY))
    assert relaxed.first().t == MAIL and "Python" not in relaxed._jdf.queryExecution().executedPlan().toString()


def test_threshold_depth_and_limits(spark):
    df = spark.createDataFrame([(MAIL,)], T.StructType([field("e", T.StringType(), Declaration("EMAIL", sensitivity=0))]))
    assert mask(df, Engine(Policy(threshold=2), KEY)).first().e == MAIL and mask(df, ENGINE).first().e == MASKED
    nested = spark.createDataFrame([([["a", "b", "c"]],)], "x array<array<string>>")
    assert mask(nested, Engine(Policy(max_elements=2), KEY)).first().x == [["a", "b"]]
    assert mask(nested, Engine(Policy(max_depth=2), KEY)).first().x == [[None] * 3]
    for bad in ({"max_depth": 0}, {"max_text": 0}, {"failure": "X"}):
        with pytest.raises(ValueError):
            Policy(**bad)
    with pytest.raises(ValueError):
        mask(df, Engine(Policy(failure="PASS_THROUGH"), KEY))


def test_types_and_overrides(spark):
    s = T.StringType()
    schema = T.StructType([field("a", s, type="Email"), field("b", s, Declaration(keep=1), type="Account"), field("c", s, Declaration("EMAIL")), field("d", s)])
    df = spark.createDataFrame([(MAIL, "12345678", MAIL, "4111111111111111")], schema)
    types = {"Email": Declaration("EMAIL"), "Account": Declaration("ACCOUNT_NUMBER")}
    r = mask(df, Engine(key=KEY, types=types, overrides=Overrides(by_path={"c": Declaration(strategy="NULLIFY")}, by_type={"string": Declaration("PAN")}))).first()
    assert tuple(r) == (MASKED, "*******8", None, "**** **** **** 1111")
    assert decided(df, Engine(key=KEY, types=types))[:2] == [("a", "EMAIL"), ("b", "PARTIAL")]
    custom = mask(df, Engine(key=KEY, maskers={"EMAIL": lambda c, d: F.lit("own")})).first()
    assert custom.c == "own"


def test_serialise(spark):
    schema = T.StructType([field("n", T.IntegerType(), Declaration("CUSTOMER_ID")), field("e", T.StringType(), Declaration("EMAIL")), field("gone", T.StringType(), Drop()), field("kept", T.IntegerType(), Keep("x"))])
    (r,) = serialise(spark.createDataFrame([(7, MAIL, "x", 3)], schema), ENGINE).collect()
    assert json.loads(r.json) == {"n": KEY.pseudonym("7"), "e": MASKED, "kept": 3}


def test_settings(spark):
    assert from_conf(spark) == STRICT
    spark.conf.set("spark.cloakframe.preset", "relaxed")
    spark.conf.set("spark.cloakframe.max-depth", "5")
    try:
        assert from_conf(spark) == Policy(threshold=2, scan_text=False, mask_keys=False, max_depth=5)
    finally:
        spark.conf.unset("spark.cloakframe.preset")
        spark.conf.unset("spark.cloakframe.max-depth")


def test_lint():
    s = T.StringType()
    bad = T.StructType(
        [
            T.StructField("a", s, True, {"pii": {"keep_as_is": " "}}),
            T.StructField("b", s, True, {"pii": {"keep_as_is": "TODO"}}),
            field("c", s, Declaration("CREDENTIAL", keep=2)),
            field("d", T.ArrayType(s), Declaration("EMAIL")),
            field("e", T.ArrayType(T.StructType([field("f", T.MapType(s, s), Declaration("EMAIL"))]))),
            T.StructField("g", s, True, {"pii": {"keep_as_is": "public", "category": "EMAIL"}}),
            field("ok", T.StructType([field("v", s)]), Declaration("EMAIL")),
        ]
    )
    found = {(p.path, p.check, p.severity) for p in lint(bad, Overrides(by_path={"nope": Declaration(), "ok.v": Declaration(masker=lambda: 1)}, dropped=frozenset({"none"})))}
    assert found == {
        ("a", "justification", "error"), ("b", "justification", "warning"), ("c", "partial-reveal", "warning"), ("d", "rebuildable", "error"), ("e[].f", "rebuildable", "error"), ("g", "contradiction", "error"),
        ("nope", "ineffective", "warning"), ("none", "ineffective", "warning"), ("ok.v", "custom-masker", "error"),
    }
    assert {p.severity for p in lint(bad, strict=False)} == {"warning"}


def test_vault(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "k int, v string")
    vault = Vault(spark, f"file://{tmp_path}/vault")
    first = {r.k: r.v for r in vault.tokenize(rows, "v", "EMAIL").collect()}
    assert first[1] == first[3] != first[2] and first[4] is None and first[1].startswith("tok_email_") and len(first[1]) == 26
    again = vault.tokenize(rows, "v", "EMAIL")
    assert {r.k: r.v for r in again.collect()} == first
    assert {r.k: r.value for r in vault.detokenize(again, "v").collect()} == {1: "a", 2: "b", 3: "a", 4: None}
    assert vault.detokenize(spark.createDataFrame([("tok_x",)], "t string"), "t").first().value is None
    assert Vault(spark, vault.path).tokenize(rows, "v", "EMAIL").filter("k = 2").first().v == first[2]
    with pytest.raises(ValueError):
        Vault(spark, vault.path, ttl_seconds=0)


def test_vault_forgets(spark, tmp_path):
    rows = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "v string")
    on_disk = lambda path: b"".join(f.read_bytes() for f in path.rglob("*.parquet"))
    short = Vault(spark, f"file://{tmp_path}/short", ttl_seconds=1)
    made = [r.v for r in short.tokenize(rows, "v").collect()]
    assert all(made) and b"alpha" in on_disk(tmp_path / "short")
    time.sleep(1.2)
    back = spark.createDataFrame([(t,) for t in made], "t string")
    assert {r.value for r in short.detokenize(back, "t").collect()} == {None}
    assert short.evict() == 0 and b"alpha" not in on_disk(tmp_path / "short")
    small = Vault(spark, f"file://{tmp_path}/small", capacity=2)
    made = [r.v for r in small.tokenize(rows, "v").collect()]
    back = spark.createDataFrame([(t,) for t in made], "t string")
    assert all(made) and len([r for r in small.detokenize(back, "t").collect() if r.value]) == 2
    assert small.evict() == 2 and small.live().count() == 2


def test_tokens_in_a_plan(spark, tmp_path):
    s = T.StringType()
    schema = T.StructType([field("mail", s, Declaration("EMAIL", strategy="TOKENIZE")), field("in", T.StructType([field("x", s, Declaration("EMAIL", strategy="TOKENIZE"))]))])
    df = spark.createDataFrame([(MAIL, (MAIL,)), (None, None), (MAIL, ("b@c.de",))], schema)
    vault = Vault(spark, f"file://{tmp_path}/plan")
    out = mask(df, Engine(key=KEY, vault=vault))
    assert out.dtypes == df.dtypes
    back = vault.detokenize(out, "mail").collect()
    assert sorted((r.value or "", r["in"].x if r["in"] else "") for r in back) == [("", ""), (MAIL, "****"), (MAIL, "****")]
    assert all(r.mail is None or r.mail.startswith("tok_email_") for r in back)
    seen = Observation("tokens")
    assert {r.mail for r in mask(df, ENGINE, seen=seen).collect()} == {"****", None}
    assert set(counters(seen)) == {("failed", "mail", 2), ("failed", "in.x", 2), ("masked", "mail", 2), ("masked", "in.x", 2)}
    with pytest.raises(MaskingFailed, match="^mail: TOKENIZE can't be applied: no vault$"):
        mask(df, Engine(Policy(failure="THROW"), KEY))


def test_engines(spark, tmp_path):
    get = lambda **conf: _with_conf(spark, conf, lambda: from_settings(spark))
    with pytest.raises(MissingSecret):
        get()
    assert get(secret="sixteen bytes or more").key == Key.of_secret("sixteen bytes or more")
    (tmp_path / "s").write_text("sixteen bytes or more\n")
    assert get(**{"secret-file": str(tmp_path / "s"), "salt": "pepper"}).key == Key.of_secret("sixteen bytes or more", b"pepper")
    one, two = get(**{"ephemeral-key": "true"}), Engine.with_defaults()
    assert one.key.ephemeral and two.key.ephemeral and one.key != two.key and two.policy == STRICT
    assert one.install() is installed() and two.install() is installed()
    own = pure.detector("own", "EMAIL", "x")
    assert one.detector(own).chosen() == (*pure.DETECTORS, own) and one.detector_first(own).chosen() == (own, *pure.DETECTORS)
    assert one.detector(own).detector_first(own).chosen() == (own, *pure.DETECTORS, own)


def _with_conf(spark, conf, run):
    for k, v in conf.items():
        spark.conf.set(f"spark.cloakframe.{k}", v)
    try:
        return run()
    finally:
        for k in conf:
            spark.conf.unset(f"spark.cloakframe.{k}")


def test_observed(spark):
    ship(spark)
    s = T.StringType()
    schema = T.StructType([field("mail", s, Declaration("EMAIL")), field("note", s, Declaration("FREEFORM_TEXT")), field("t", s), field("deep", T.ArrayType(T.ArrayType(s))), field("far", T.StructType([field("a", T.StructType([field("b", s)]))]))])
    rows = [(MAIL, f"of {MAIL}", "**** is no finding", [[MAIL, "x"], [f"{MAIL} {MAIL}"]], (("x",),)), (None, None, "x" * 90, [["a"], ["b"], ["c"]], None), ("no mail", "none", "card 4111111111111111", None, None)]
    out, seen = observed(spark.createDataFrame(rows, schema), Engine(Policy(max_text=80, max_elements=2, max_depth=2, placeholder="[gone]"), KEY))
    got = out.collect()
    assert seen.get["rows"] == 3 and len(got) == 3 and got[0].t == "**** is no finding"
    told = counters(seen)
    assert {x for x in told if x[0] != "depth_exceeded"} == {("masked", "mail", 2), ("masked", "note", 2), ("scanned", "note", 1), ("unannotated", "t", 1), ("text_truncated", "t", 1), ("collection_truncated", "deep", 1)}
    assert {x[1] for x in told if x[0] == "depth_exceeded"} == {"far.a.b", "deep[][]"}
    heard = []

    def broken(*x):
        raise OSError

    report(seen, broken, lambda *x: heard.append(x))
    assert heard == told
    df = spark.createDataFrame([(1, f"to {MAIL}"), (3, "card 4111111111111111")], "k int, t string")
    assert {(r.category, r.findings) for r in findings_by(df, "t").collect()} == {("EMAIL", 1), ("PAN", 1)}
