"""Registered queries of messages of unknown shape; tests hold them against plain Python over all messages. Each event is
a message in one of nine shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons
from .queries import _table

#: $i, $u, $v, $t and $k stand for the event's number, user, value, type and inner number.
SHAPES = [
    '{"type": "$t", "data": {"token_id": "$u", "seq": $i, "price": $v, "size": $k}, "ts": $i}',
    '{"topic": "book.$u", "events": [{"bids": [[$v, $k]], "sequence": $i}, {"asks": [], "seq": "$k"}, $k], "token_id": $u, "meta": {"é": "ü $t\\n"}}',
    '[{"price": $v, "amount": $k, "nested": [{"offset": $k}, {"seq": $v}]}, "text", null, {"event": "TRADE $t"}]',
    '{"channel": null, "event": " ", "items": [], "results": {"price": $v, "size": null, "data": {"size": $k, "price": -1}}, "seq": {"seq": {"seq": "$i"}}}',
    '{"zeta": {"beta": [1, 2.5000004, -0.0, $v], "alpha": {"y": null, "x": ""}}, "seq": null, "sequence": "n$k", "big": 12345678901234567890123}',
    '{"heartbeat": true, "at": "$i", "rate": 0.0000004, "share": $v, "emoji": "😀 \\"quoted, \\"seq\\":5\\" ["}',
    '"$t"',
    "{broken $t",
    '{"books": {"bids": null, "asks": [[$v, 1]], "sequence": 1.5}, "trades": [{"price": 1, "size": 1}], "seq": true, "offset": " $k "}',
]
FIELDS = ["seq", "sequence", "offset"]


def messages(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    at = lambda c: F.col(c).cast("string")
    fill = {"$i": at("event_id"), "$u": at("user_id"), "$v": at("value"), "$t": F.col("event_type"), "$k": F.get_json_object("props", "$.k")}
    raw = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("event_id") % len(SHAPES) + 1).cast("int"))
    for name, value in fill.items():
        raw = F.replace(raw, F.lit(name), value)
    return e.select(F.col("event_id").alias("id"), raw.alias("raw"))


def _parsed(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("v", jsons.parsed(F.col("raw")))


def _canonical(spark, sf_dir):
    v = F.col("v")
    return _parsed(spark, sf_dir).select("id", jsons.canonical(v).alias("canonical"), jsons.canonical_hash(v).alias("hash"), jsons.find_int(v, FIELDS).alias("seq"))


def _rows(spark, sf_dir):
    rows = _parsed(spark, sf_dir).select("id", F.posexplode(jsons.envelope_rows(F.col("v"))).alias("i", "row"))
    return rows.select("id", "i", jsons.channel(F.col("row")).alias("channel"), jsons.text_at(F.col("row"), "token_id").alias("token_id"), jsons.canonical(F.to_variant_object("row")).alias("fields"))


def _filled(spark, sf_dir):
    """Each message with what the next of its own shape adds to it."""
    m = _parsed(spark, sf_dir)
    later = m.select((F.col("id") - len(SHAPES)).alias("id"), F.col("v").alias("incoming"))
    other = m.select((F.col("id") + 1).alias("id"), F.col("v").alias("existing"))
    both = other.join(later, "id")
    return both.select("id", jsons.canonical(jsons.fill_missing(F.col("existing"), F.col("incoming"))).alias("filled"))


QUERIES = {"message_hashes": _canonical, "message_rows": _rows, "messages_filled": _filled}
ORACLES: dict[str, str] = {}
