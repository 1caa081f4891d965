"""Fixed schemas: feed message, ping table, track segments."""

from __future__ import annotations

from pyspark.sql import types as T

#: One element of a feed message; everything is text but the two flags.
VEHICLE = (
    "struct<vid:string,tmstmp:string,lat:string,lon:string,hdg:string,rt:string,tatripid:string,des:string,spd:string,"
    "dly:boolean,`or`:boolean,pdist:string,pid:string,rid:string,tablockid:string,srvtmstmp:string>"
)
MESSAGE = f"array<{VEHICLE}>"

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}


def _schema(fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in fields.split(","))])


#: The ping table, without its partition column event_date.
PINGS = _schema(
    "vid string, timestamp timestamp_ntz, lat double, lon double, heading int, route string, trip_id string, destination string, speed int, "
    "is_delayed boolean, is_off_route boolean, segment_id int, segment_name string, segment_type string, pdist int, pid int, rid string, "
    "tablockid string, srvtmstmp string"
)
#: Columns that older tables lack.
LATE_COLUMNS = ("pdist", "pid", "rid", "tablockid", "srvtmstmp")

SEGMENTS = _schema("id int, route string, name string, type string, min_lat double, max_lat double, min_lon double, max_lon double, order int")

# Track segments of route 12, in the order in which they are tried.
SEGMENT_ROWS = [
    (1, "12", "Canal Street (CBD)", "mixed_traffic", 29.9495, 29.9650, -90.0800, -90.0650, 1),
    (2, "12", "Lee Circle / Downtown", "mixed_traffic", 29.9430, 29.9495, -90.0820, -90.0700, 2),
    (3, "12", "St. Charles - Lower Garden District", "dedicated_row", 29.9250, 29.9430, -90.0900, -90.0750, 3),
    (4, "12", "St. Charles - Garden District", "dedicated_row", 29.9150, 29.9250, -90.1050, -90.0900, 4),
    (5, "12", "St. Charles - Uptown", "dedicated_row", 29.9150, 29.9350, -90.1300, -90.1050, 5),
    (6, "12", "Carrollton - Riverbend", "dedicated_row", 29.9350, 29.9550, -90.1400, -90.1250, 6),
    (7, "12", "S. Carrollton Ave", "dedicated_row", 29.9550, 29.9750, -90.1350, -90.1200, 7),
]
