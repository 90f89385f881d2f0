"""Vessel messages: parsing, latest state per vessel, and bounded tracks, in batch and on a stream."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AREAS
from ..functions.codes import flag_state, nav_status_text, ship_class, ship_type_text
from ..functions.numbers import in_range
from ..functions.text import untrusted
from ..operators.timeline import with_previous
from .vessel_state import VesselProcessor, packed_states

POSITION_KINDS = ["PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport"]
_POS = "struct<UserID:string,Latitude:string,Longitude:string,Sog:string,Cog:string,TrueHeading:string,NavigationalStatus:int,Type:int>"
MESSAGE = (
    "MessageType string, MetaData struct<MMSI:string,ShipName:string>, Message struct<"
    f"PositionReport:{_POS},StandardClassBPositionReport:{_POS},ExtendedClassBPositionReport:{_POS},"
    "ShipStaticData:struct<UserID:string,Name:string,CallSign:string,ImoNumber:double,Type:int,Destination:string,"
    "MaximumStaticDraught:string,Dimension:struct<A:string,B:string,C:string,D:string>,"
    "Eta:struct<Month:int,Day:int,Hour:int,Minute:int>>,"
    "StaticDataReport:struct<UserID:string,ReportA:struct<Valid:boolean,Name:string>,"
    "ReportB:struct<Valid:boolean,ShipType:int,CallSign:string>>>")


def parse_messages(raw: DataFrame, body: str = "value", at: str = "ts") -> DataFrame:
    """JSON text -> typed rows of vessels with a nine-digit number; sentinels become nulls.

    Position messages without a usable position are dropped, as are messages of other kinds.
    """
    # Parsed once: a generator keeps the JSON parser from being copied into every field below.
    d = raw.select("*", F.inline(F.array(F.from_json(body, MESSAGE))))
    d = d.select(*raw.columns, F.struct("MessageType", "MetaData", "Message").alias("_m")).withColumn("kind", F.col("_m.MessageType"))
    pos = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"_m.Message.{k}")) for k in POSITION_KINDS])
    s, r = F.col("_m.Message.ShipStaticData"), F.col("_m.Message.StaticDataReport")
    number = F.coalesce(F.nullif(F.nullif(F.col("_m.MetaData.MMSI"), F.lit("")), F.lit("0")), pos["UserID"], s["UserID"], r["UserID"])
    d = d.withColumns({"mmsi": number.try_cast("bigint"), "_p": pos})
    p = F.col("_p")
    is_pos = F.col("kind").isin(POSITION_KINDS)
    is_static = F.col("kind") == "ShipStaticData"
    is_report = F.col("kind") == "StaticDataReport"

    def metres(a: str, b: str) -> Column:
        total = F.coalesce(in_range(s["Dimension"][a], 0), F.lit(0.0)) + F.coalesce(in_range(s["Dimension"][b], 0), F.lit(0.0))
        return F.nullif(total, F.lit(0.0))

    eta = s["Eta"]
    has_eta = (F.coalesce(eta["Month"], F.lit(0)) > 0) & (F.coalesce(eta["Day"], F.lit(0)) > 0)
    valid_b = F.coalesce(r["ReportB"]["Valid"], F.lit(False))
    out = d.select(
        "mmsi", F.col(at).alias("ts"), "kind", is_pos.alias("is_position"), (is_static | is_report).alias("is_static"),
        F.round(in_range(p["Latitude"], 91, -90, 90), 5).alias("lat"), F.round(in_range(p["Longitude"], 181, -180, 180), 5).alias("lon"),
        in_range(p["Sog"], 102.3, 0, 102.2).alias("sog"), in_range(p["Cog"], 360, 0, 359.9).alias("cog"),
        in_range(p["TrueHeading"], 511, 0, 359).alias("heading"),
        F.when(F.col("kind") == "PositionReport", nav_status_text(p["NavigationalStatus"])).alias("nav"),
        (F.col("kind") == "PositionReport").alias("has_nav"),
        untrusted(F.col("_m.MetaData.ShipName")).alias("meta_name"),
        F.when(is_static, untrusted(s["Name"])).when(is_report & F.coalesce(r["ReportA"]["Valid"], F.lit(False)),
                                                     untrusted(r["ReportA"]["Name"])).alias("static_name"),
        F.when(is_static, s["Type"]).when(is_report & valid_b, r["ReportB"]["ShipType"])
        .when(F.col("kind") == "ExtendedClassBPositionReport", p["Type"]).alias("type"),
        F.when(is_static, untrusted(s["CallSign"], 10)).when(is_report & valid_b, untrusted(r["ReportB"]["CallSign"], 10)).alias("callsign"),
        F.when(is_static, in_range(s["ImoNumber"], None, 1_000_000, 9_999_999).cast("bigint")).alias("imo"),
        F.when(is_static, untrusted(s["Destination"])).alias("destination"),
        F.when(is_static, in_range(s["MaximumStaticDraught"], 0, 0, 30)).alias("draught"),
        F.when(is_static, metres("A", "B")).alias("length"), F.when(is_static, metres("C", "D")).alias("beam"),
        F.when(is_static & has_eta, F.format_string(
            "%02d-%02d %02d:%02d UTC", eta["Month"], eta["Day"], F.coalesce(eta["Hour"], F.lit(0)),
            F.coalesce(eta["Minute"], F.lit(0)))).alias("eta"), is_static.alias("full_static"))
    known = F.col("mmsi").between(100_000_000, 999_999_999)
    usable = F.col("is_static") | (F.col("is_position") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return out.where(known & usable)


def in_area(df: DataFrame, names: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows inside any of the named boxes; works on a stream as well."""
    unknown = sorted(set(names) - set(AREAS))
    if unknown:
        raise KeyError(f"unknown areas {unknown}; known: {sorted(AREAS)}")
    ok = F.lit(False)
    for n in names:
        a, b, c, d = AREAS[n]
        ok = ok | (F.col(lat).between(a, c) & F.col(lon).between(b, d))
    return df.where(ok)


def latest_state(messages: DataFrame, tie: str | None = None) -> DataFrame:
    """Latest state per vessel as one aggregation, so a busy vessel is reduced before the shuffle.

    Each group of fields keeps the values of its own latest message: positions overwrite all position
    fields, static messages overwrite theirs, but name, number and call sign survive an empty update.
    Valid in batch and, in update mode, on a stream.
    """
    when = F.struct("ts", tie) if tie else F.col("ts")

    def last(value: Column, cond: Column) -> Column:
        return F.max_by(value, F.when(cond, when))

    is_pos, full = F.col("is_position"), F.col("full_static")
    pos = last(F.struct("lat", "lon", "sog", "cog", "heading", "ts"), is_pos)
    ship = last(F.struct("destination", "draught", "length", "beam"), full)
    g = messages.groupBy("mmsi").agg(
        pos.alias("p"), ship.alias("s"), last(F.col("nav"), is_pos & F.col("has_nav")).alias("nav"),
        last(F.col("static_name"), F.col("static_name").isNotNull()).alias("sn"),
        F.min_by("meta_name", F.when(F.col("meta_name").isNotNull(), when)).alias("mn"),
        last(F.col("type"), F.col("type").isNotNull()).alias("type"),
        last(F.col("callsign"), full | F.col("callsign").isNotNull()).alias("callsign"),
        last(F.col("imo"), F.col("imo").isNotNull()).alias("imo"), last(F.col("eta"), F.col("eta").isNotNull()).alias("eta"),
        F.max(F.when(F.col("is_static"), F.col("ts"))).alias("static_at"), F.count("*").alias("n_messages"))
    return g.select("mmsi", F.coalesce("sn", "mn").alias("name"), "p.lat", "p.lon", "p.sog", "p.cog", "p.heading", "nav", "type",
                    "callsign", "imo", "eta", "s.destination", "s.draught", "s.length", "s.beam",
                    F.col("p.ts").alias("position_at"), "static_at", "n_messages")


def tracks(messages: DataFrame, tie: str, track_len: int = 60, bucket_seconds: int = 3600) -> DataFrame:
    """Last ``track_len`` distinct consecutive positions per vessel, oldest first.

    Moves are found inside (vessel, hour) with stitched edges; each hour keeps at most track_len of them,
    and only those are ranked per vessel.
    """
    pos = messages.where("is_position")
    d = with_previous(pos, ["mmsi"], "ts", [tie], ["lat", "lon"], bucket_seconds, "_prev")
    moved = F.col("_prev").isNull() | (F.col("_prev.lat") != F.col("lat")) | (F.col("_prev.lon") != F.col("lon"))
    d = d.where(moved)
    order = [F.col("ts").desc(), F.col(tie).desc()]
    local = Window.partitionBy("mmsi", "_bucket").orderBy(*order)
    d = d.withColumn("_rn", F.row_number().over(local)).where(F.col("_rn") <= track_len)
    whole = Window.partitionBy("mmsi").orderBy(*order)
    d = d.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= track_len)
    pts = F.sort_array(F.collect_list(F.struct("ts", F.col(tie).alias("k"), "lat", "lon")))
    return d.groupBy("mmsi").agg(F.transform(pts, lambda x: F.struct(x["lat"], x["lon"])).alias("track"))


def snapshot(state: DataFrame, now: Column, stale_after_s: int = 3600) -> DataFrame:
    """Vessels with a position that were heard of lately, with class, type text, flag and age."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("position_at", "static_at"))
    d = state.where((age <= stale_after_s) & F.col("lat").isNotNull())
    return d.withColumns({"ship_class": ship_class(F.col("type")), "type_text": ship_type_text(F.col("type")),
                          "flag": flag_state(F.col("mmsi")), "age_s": age})


def class_counts(snap: DataFrame) -> DataFrame:
    return snap.groupBy("ship_class").agg(F.count("*").alias("n_vessels"))


def track_stream(messages: DataFrame, stale_after_s: int = 3600, track_len: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Streaming state per vessel with a bounded track, dropped after silence measured in event time.

    A few columns of the state that ``vessel_state`` keeps, in time order also where messages come late. Emits one row per touched
    vessel and batch, and one marked expired when the watermark passes the last message of any kind by ``stale_after_s``.
    """
    d = packed_states(messages, VesselProcessor(stale_after_s, track_len, by_position=False), delay)
    return d.select("mmsi", F.timestamp_micros("last_us").alias("last_at"), "lat", "lon", "sog", F.coalesce("static_name", "meta_name").alias("name"), "type",
                    F.col("n_messages").alias("n"), "track_lat", "track_lon", "expired")
