"""Reviews made from orders by one SQL expression that any engine evaluates alike; a stand-in for real reviews in tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BASE = [
    "very good quality product and fast delivery", "bad quality not worth the money", "not as described wrong size and the seller gave no response",
    "good packaging but late delivery and poor packing", "ok", "nice product", "คุณภาพดี ส่งไว แพ็คดี ค่ะ", "ไม่คุ้ม ส่งช้า บริการแย่ คับ",
    "soooo gooood!!!! value for money", "box damaged and broken product never buy", "the seller was helpful and the price is cheap thanks to support",
    "ราคา ถูก ทน แนะนำ ร้าน ดี", "ofthis product thatwas excellent andthe delivery was never late", "I like the speaker but the kettle is not good",
    "ส่ง ถึง เชียงใหม่ เร็ว กล่อง บุบ ไม่ ชอบ", "no issue with this phone, it works well and great value",
]
_MONEY = ["''", "concat(' Rs. ', cast(cast(floor(o_totalprice) as bigint) as string))", "' ฿1,290'", "concat(' price ', cast(o_custkey % 900 as string), '.5 rs')", "' 890 บาท'", "''"]
_TIME = ["''", "' delivered in 3 days'", "' ภายใน 5 วัน'", "' took 1000 days, then 12 days'", "' 4 stars'", "' 3.5/5'", "' ได้ 9 ดาว'"]
_MORE = [
    "''", "' size: L color red'", "' Samsung by Kerry Express from Shopee'", "' sony and JBL via flash'", "' 5 ม.ค. 2567'", "' สี: ดำ model X20 size the'", "' <b>bold</b> &amp; more'",
    "' 😀👍🏽 nice'", "' in เลย and ที่ ตาก'", "' a  b   c'", "' VERY VERY GOOD'",
]
_CONTACT = ["''", "' call 081-234-5678 now'", "' contact me line id: shop99'", "' see https://x.example.com/a?b=1 order now'", "' mail a.b@mail.example.com'", "' fb: my.shop whatsapp 0812345678'", "''", "''", "''", "''", "''", "''", "''"]


def _pick(column: str, choices: list[str]) -> str:
    return f"case cast({column} % {len(choices)} as int) " + " ".join(f"when {k} then {c}" for k, c in enumerate(choices)) + " end"


def _looked_up(column: str, choices: list[str]) -> str:
    """``_pick`` for Spark, texts from one array: with a branch for each of them, the code that Spark makes of the reviews is
    longer than what Java compiles, and is interpreted for every row."""
    if all(c.startswith("'") for c in choices):
        return f"get(array({', '.join(choices)}), cast({column} % {len(choices)} as int))"
    return _pick(column, choices)


_POS = "o_orderkey"


def _reviews_sql(pick: Callable[[str, list[str]], str]) -> str:
    return f"""select cast({_POS} as bigint) as pos, concat('R', cast(cast({_POS} as bigint) as string)) as review_id,
  concat({pick('o_custkey', [f"'{b}'" for b in _BASE])}, {pick('cast(floor(o_totalprice) as bigint)', _MONEY)}, {pick('(o_orderkey + o_custkey)', _TIME)}, {pick('cast(floor(o_totalprice / 7) as bigint)', _MORE)}, {pick('cast(floor(o_totalprice / 100) as bigint)', _CONTACT)}) as raw_text,
  {pick('cast(floor(o_totalprice / 11) as bigint)', ["''", "'Steel kettle 2L'", "'phone case'", "''", "'ลำโพง บลูทูธ'", "''", "''"])} as product_name,
  case o_orderstatus when 'F' then 'positive' when 'O' then 'neutral' else 'negative' end as sentiment_label,
  {pick('o_custkey', ["'quality:pos|shipping:pos'", "'quality:neg | price_value:neg'", "''", "'packaging:pos|shipping:neg|oops'", "'price_value:pos'"])} as expected_aspects,
  {pick('o_custkey', ["'price|ad_spam'", "'delivery_days|duplicate'", "'untagged'", "'low_quality|elongation'", "'pii_phone|pii_line|pii_url'", "'pii_email|html|code_switch'", "'ad_spam'"])} as case_tags
from orders"""


REVIEWS_SQL = _reviews_sql(_pick)
_SPARK_SQL = _reviews_sql(_looked_up)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK_SQL.replace("from orders", "from {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


#: A raw product dump with shifted rows, missing and blank texts and garbled names.
DUMP_SQL = f"""select pos, review_id, {_pick('pos', ["'5'", "'4'", "'1'", "'Great product'", "'3'", "'10'", "cast(null as string)", "'2'"])} as Rate,
  case cast(pos % 13 as int) when 0 then cast(null as string) when 1 then '   ' else concat(' ', raw_text, ' ') end as Summary,
  case cast(pos % 3 as int) when 0 then 'Cooler ??? 20L  big' when 1 then 'FanÃÂ x' else 'Iron' end as product_name, concat('₹', cast(cast(pos % 9999 as bigint) as string), ',000.50') as product_price, sentiment_label as Sentiment from ({REVIEWS_SQL}) r"""


def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DUMP_SQL.replace(REVIEWS_SQL, _SPARK_SQL).replace("from orders", "from {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
