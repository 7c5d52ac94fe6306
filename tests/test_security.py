import hashlib
import hmac

from pyspark.sql import functions as F

from runlens.functions import security as SEC


def test_hmac_matches_python(spark):
    payloads = ["", "a", '{"action":"completed"}', "x" * 200, "ünïcode ✓"]
    for secret in ["s3cret", "k" * 100]:  # long keys are hashed first
        df = spark.createDataFrame([(p,) for p in payloads], "payload string")
        got = [r.sig for r in df.select(SEC.signature_of(F.col("payload"), secret).alias("sig")).collect()]
        want = ["sha256=" + hmac.new(secret.encode(), p.encode(), hashlib.sha256).hexdigest() for p in payloads]
        assert got == want


def test_verify_signature_rejects_corrupt_and_empty(spark):
    secret = "topsecret"
    rows = []
    for i in range(12):
        p = f'{{"id": {i}}}'
        sig = "sha256=" + hmac.new(secret.encode(), p.encode(), hashlib.sha256).hexdigest()
        if i % 3 == 0:
            sig = sig[:-1] + ("0" if sig[-1] != "0" else "1")
        rows.append((i, p, sig if i != 4 else ""))
    df = spark.createDataFrame(rows, "i int, payload string, signature string")
    got = {r.i: r.ok for r in df.select("i", SEC.verify_signature(F.col("payload"), F.col("signature"), secret).alias("ok")).collect()}
    assert got == {i: (i % 3 != 0 and i != 4) for i in range(12)}


def test_secret_scan_and_redact(spark):
    df = spark.createDataFrame([(1, 'token = "abc123" and Password: hunter2'), (2, "tokens are fine"), (3, "no secrets")],
                               "doc_id long, text string")
    r = {x.doc_id: x for x in df.select("doc_id", F.array_join(SEC.found_keywords(F.col("text")), ",").alias("k"),
                                          SEC.redact(F.col("text")).alias("red"), SEC.count_assignments(F.col("text")).alias("n")).collect()}
    assert r[1].k == "password,token" and r[1].n == 2
    assert r[1].red == "token = *** and Password: ***"
    assert r[2].k == "" and r[2].red == "tokens are fine"


def test_redact_masks_whole_values(spark):
    cases = [('password = "two words here" and more', "password = *** and more"), ('{"token": "x", "a": 1}', '{"token": ***, "a": 1}'),
             ("DB_PASSWORD=x\nrest", "DB_PASSWORD=***\nrest"), ("secret: 'a b' c", "secret: *** c"),
             (r'api_key="a \" b" c', "api_key=*** c"), ('token="open value', "token=*** value"), ("mytoken=x tokens: y", None),
             ('password = ""', None), ("token = plain rest", "token = *** rest")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    got = {r.i: (r.red, r.n) for r in df.select("i", SEC.redact(F.col("text")).alias("red"), SEC.count_assignments(F.col("text")).alias("n")).collect()}
    assert got == {i: (want or text, int(want is not None)) for i, (text, want) in enumerate(cases)}


def test_sql_twin_masks_the_same(spark):
    """The pattern without Java's marks, in DuckDB, on texts that tell the two forms apart."""
    import duckdb
    texts = ['{"token": "abc"}', "DB_PASSWORD=hunter2", 'password="my secret pass"', "token = x", "secret: 'a b' c", r'api_key="a \" b" c',
             'token="open value', 'password = ""', "mytoken=x", "token\t:\t'a\\\\' b", 'password="a\nb"', 'secret="\\n" x', "Token=ÄÖ ü", "token="]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [tuple(r) for r in df.orderBy("i").select(SEC.redact(F.col("text")), SEC.count_assignments(F.col("text")),
                                                     F.array_join(SEC.found_keywords(F.col("text")), ",")).collect()]
    con = duckdb.connect()
    con.execute("create table d (i int, text varchar)")
    con.executemany("insert into d values (?, ?)", list(enumerate(texts)))
    p = SEC.masked_pattern(possessive=False)
    kw = "concat_ws(',', " + ", ".join(f"case when regexp_matches(text, '{SEC.keyword_pattern(k)}') then '{k}' end" for k in SEC.SECRET_KEYWORDS) + ")"
    want = con.execute(f"select regexp_replace(text, ?, '\\1\\2\\3***', 'g'), len(regexp_extract_all(text, ?)), {kw} from d order by i", [p, p]).fetchall()
    assert got == want
    assert [r[1] for r in got[:4]] == [1, 1, 1, 1] and got[1] == ("DB_PASSWORD=***", 1, "password")
