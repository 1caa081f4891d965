"""From feed messages to typed pings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingworks.functions import parsing as P
from pingworks.schemas import MESSAGE


def parse_messages(messages: DataFrame) -> DataFrame:
    """(message_no, received_at, value) to (…, vehicles, malformed).  A text that is no
    JSON array is malformed; it never stops its neighbours."""
    vehicles = F.when(F.ltrim("value").startswith("["), F.from_json("value", MESSAGE))
    return messages.withColumn("vehicles", vehicles).withColumn("malformed", F.col("vehicles").isNull())


def explode_vehicles(parsed: DataFrame) -> DataFrame:
    """One row an element, with its place in the message; null elements are dropped."""
    keep = [c for c in parsed.columns if c not in ("vehicles", "malformed", "value")]
    rows = parsed.filter(~F.col("malformed")).select(*keep, F.posexplode("vehicles").alias("pos", "v"))
    return rows.filter(F.col("v").isNotNull()).select(*keep, "pos", "v.*")


def clean(vehicles: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Typed pings with ``status``: ok, invalid (both coordinates "0") or bad
    (a coordinate or the time cannot be read)."""
    c = F.col
    lat, lon, ts = P.leading_float(c("lat")), P.leading_float(c("lon")), c("tmstmp").try_cast("timestamp_ntz")
    zero = F.coalesce((c("lat") == "0") & (c("lon") == "0"), F.lit(False))
    status = F.when(zero, "invalid").when(lat.isNull() | lon.isNull() | ts.isNull(), "bad").otherwise("ok")
    return vehicles.select(
        *extra, c("vid"), ts.alias("timestamp"), lat.alias("lat"), lon.alias("lon"),
        P.leading_int_or_zero(c("hdg")).alias("heading"), c("rt").alias("route"), c("tatripid").alias("trip_id"),
        P.empty_to_null(c("des")).alias("destination"), P.leading_int_or_zero(c("spd")).alias("speed"),
        P.strict_flag(c("dly")).alias("is_delayed"), P.strict_flag(c("or")).alias("is_off_route"),
        P.leading_int(c("pdist")).alias("pdist"), P.leading_int(c("pid")).alias("pid"),
        P.empty_to_null(c("rid")).alias("rid"), P.empty_to_null(c("tablockid")).alias("tablockid"),
        P.empty_to_null(c("srvtmstmp")).alias("srvtmstmp"), c("tmstmp").alias("order_key"), status.alias("status"),
    )


def rejected(messages: DataFrame) -> DataFrame:
    """(message_no, received_at, pos, reason, payload) of what ingest sets aside: texts
    that are no JSON array (malformed, pos null) and pings whose coordinates or time cannot
    be read (bad), whole, so that they can be mended and sent again."""
    parsed = parse_messages(messages)
    texts = parsed.filter("malformed").select("message_no", "received_at", F.lit(None).cast("int").alias("pos"), F.lit("malformed").alias("reason"), F.col("value").alias("payload"))
    rows = explode_vehicles(parsed)
    fields = [c for c in rows.columns if c not in ("message_no", "received_at", "pos")]
    rows = rows.withColumn("payload", F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields])))
    bad = clean(rows, ("message_no", "received_at", "pos", "payload")).filter("status = 'bad'")
    return texts.unionByName(bad.select("message_no", "received_at", "pos", F.lit("bad").alias("reason"), "payload"))
