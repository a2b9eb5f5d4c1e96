"""Table schemas and the fixed vocabulary of the shipment-leg model.

Schemas are declared, never inferred. Times stay as text beside their typed
form because some rules match on the text and reports print it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)


def _fields(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind, True) for n in names.split()]


def with_text(schema: T.StructType, names: Sequence[str]) -> T.StructType:
    """The schema with further text columns, such as street addresses."""
    return T.StructType(schema.fields + [T.StructField(n, T.StringType(), True) for n in names])


LEGS = T.StructType(
    _fields(
        "orderCode warpId loadId shipmentType mainShipment shipmentStatus pickStatus dropStatus "
        "clientName carrierName carrierSaleRep startMarket endMarket "
        "pickLocationName dropLocationName pickCity pickState dropCity dropState "
        "pickWindowFrom pickWindowTo pickTimeArrived pickTimeDeparted "
        "dropWindowFrom dropWindowTo dropTimeArrived dropTimeDeparted dropDateArrived "
        "loadBookedTime pickupDelayCode deliveryDelayCode equipment",
        T.StringType(),
    )
    + _fields("revenueAllocationNumber costAllocationNumber", MONEY)
    + _fields("pieces", T.IntegerType())
)

ROUTES = T.StructType(
    _fields("routeId", T.StringType())
    + _fields("palletCount", T.LongType())
    + _fields("transitCost shipmentCodes shipmentWarpIds", T.StringType())
)

ORDERS = T.StructType(
    _fields(
        "code customerName shipmentType status revenueAllocation costAllocation createdAt",
        T.StringType(),
    )
    + _fields("warpId", T.LongType())
)

CARRIERS = CLIENTS = T.StructType(_fields("id name", T.StringType()))
SHIPMENTS = T.StructType(_fields("warpId parent code", T.StringType()))

# --- fixed values: codes the tables hold -----------------------------------
FTL = "Full Truckload"
LTL = "Less Than Truckload"
PARCEL = "Parcel"
LTL_CROSSDOCK = "LTL_CD"
ALL_TYPES = "All"
SHIPMENT_TYPES = (ALL_TYPES, FTL, LTL, PARCEL)

COMPLETE = "Complete"
SUCCEEDED = "Succeeded"
HEADER = "YES"
LEG = "NO"

INVALID_DATE = "Invalid date"
NO_CODE = "No Code"
CARRIER_FAILURE = "Carrier Failure"

TIMESTAMP_TEXT = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{1,2}:\d{1,2})$"
DATE_TEXT = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
ISO_DATE_TEXT = "yyyy-MM-dd"

# Typed column added by staging -> text column it is read from.
TYPED_TIMES = {
    "pick_from_ts": "pickWindowFrom",
    "pick_to_ts": "pickWindowTo",
    "pick_arrived_ts": "pickTimeArrived",
    "pick_departed_ts": "pickTimeDeparted",
    "drop_from_ts": "dropWindowFrom",
    "drop_to_ts": "dropWindowTo",
    "drop_arrived_ts": "dropTimeArrived",
    "drop_departed_ts": "dropTimeDeparted",
    "booked_ts": "loadBookedTime",
}

# Partition columns of the staged leg table: the pickup month, and the months of
# the earlier and the later of its two delivery times (effective and window).
MONTHS = ("pick_month", "first_drop_month", "last_drop_month")

# Days of the dates that reports cut by: files keep statistics of days that skip
# row groups, which zone-less timestamps cannot.
DAYS = {"pick_day": "pick_from_ts", "delivered_day": "delivered_ts", "drop_day": "drop_from_ts"}

# Layout of the staged leg table.
STAGED_LEGS = T.StructType(
    LEGS.fields
    + _fields(" ".join(TYPED_TIMES), T.TimestampNTZType())
    + _fields("drop_date", T.DateType())
    + _fields("delivered_ts", T.TimestampNTZType())
    + _fields(" ".join(DAYS), T.DateType())
    + _fields(" ".join(MONTHS), T.DateType())
)

# --- fixed values: cross-dock names and the market each stands for ----------
CROSSDOCK_NAMES = ("WTCH-%", "ACCL-%", "SB-%", "%Cross-Dock%")
# Names whose characters 6-8 are the market code itself.
CODED_DOCKS = ("WTCH-%", "ACCL-%")
NAMED_DOCKS = (
    ("SB-ATL-%", "ATL"),
    ("SB-DC-%", "DCA"),
    ("SB-DAL-%", "DFW"),
    ("SB-SEA-%", "SEA"),
    ("SB-LA-%", "LAX"),
    ("SB-DEN-%", "DEN"),
    ("SB-NYC-%", "EWR"),
    ("SB-PHX-%", "PHX"),
    ("SB-MIA-%", "MIA"),
    ("%GoBolt%NYC%Cross-Dock%", "EWR"),
    ("%Cross-Dock%Chicago%", "ORD"),
)

# --- fixed values: performance targets, per cent ----------------------------
TARGETS = {"otp": 98.5, "otd": 99.9, "tracking": 100.0}
OTD_TARGET_ALTERNATIVE = 98.0
