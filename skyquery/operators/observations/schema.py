"""Columns of the main table and of its dimension tables."""

from __future__ import annotations

from pyspark.sql import types as T

I, D, S, B, F32 = T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.FloatType()  # noqa: E741
COMPLEX = T.StructType([T.StructField("re", F32), T.StructField("im", F32)])


def _a(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


def _struct(spec: dict[str, T.DataType], optional: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, k, True, {"required": n not in optional}) for n, k in spec.items()])


# The columns; arrays of more than one axis are flattened with the first axis fastest.
MAIN = _struct(
    {
        **dict.fromkeys(("ANTENNA1", "ANTENNA2", "ARRAY_ID", "DATA_DESC_ID", "FEED1", "FEED2", "FIELD_ID", "OBSERVATION_ID", "PROCESSOR_ID", "SCAN_NUMBER", "STATE_ID"), I),
        **dict.fromkeys(("EXPOSURE", "INTERVAL", "TIME", "TIME_CENTROID"), D), "FLAG_ROW": B, "FLAG": _a(B), "FLAG_CATEGORY": _a(B), "SIGMA": _a(F32), "WEIGHT": _a(F32), "UVW": _a(D),
        **dict.fromkeys(("DATA", "CORRECTED_DATA", "MODEL_DATA"), _a(COMPLEX)), **dict.fromkeys(("FLOAT_DATA", "WEIGHT_SPECTRUM", "SIGMA_SPECTRUM", "IMAGING_WEIGHT"), _a(F32)), "FLAG_SPECTRUM": _a(B),
    },
    ("DATA", "CORRECTED_DATA", "MODEL_DATA", "FLOAT_DATA", "WEIGHT_SPECTRUM", "SIGMA_SPECTRUM", "IMAGING_WEIGHT", "FLAG_SPECTRUM"),
)
SUBTABLES: dict[str, T.StructType] = {
    "ANTENNA": _struct({"NAME": S, "STATION": S, "TYPE": S, "MOUNT": S, "POSITION": _a(D), "OFFSET": _a(D), "DISH_DIAMETER": D, "FLAG_ROW": B}),
    "DATA_DESCRIPTION": _struct({"SPECTRAL_WINDOW_ID": I, "POLARIZATION_ID": I, "FLAG_ROW": B}),
    "FEED": _struct({"ANTENNA_ID": I, "FEED_ID": I, "SPECTRAL_WINDOW_ID": I, "TIME": D, "INTERVAL": D, "NUM_RECEPTORS": I, "BEAM_ID": I, "BEAM_OFFSET": _a(D), "POLARIZATION_TYPE": _a(S), "POL_RESPONSE": _a(COMPLEX), "POSITION": _a(D), "RECEPTOR_ANGLE": _a(D)}),
    "FIELD": _struct({"NAME": S, "CODE": S, "TIME": D, "NUM_POLY": I, "DELAY_DIR": _a(D), "PHASE_DIR": _a(D), "REFERENCE_DIR": _a(D), "SOURCE_ID": I, "FLAG_ROW": B}),
    "FLAG_CMD": _struct({"TIME": D, "INTERVAL": D, "TYPE": S, "REASON": S, "LEVEL": I, "SEVERITY": I, "APPLIED": B, "COMMAND": S}),
    "HISTORY": _struct({"TIME": D, "OBSERVATION_ID": I, "MESSAGE": S, "PRIORITY": S, "ORIGIN": S, "OBJECT_ID": I, "APPLICATION": S, "CLI_COMMAND": _a(S), "APP_PARAMS": _a(S)}),
    "OBSERVATION": _struct({"TELESCOPE_NAME": S, "TIME_RANGE": _a(D), "OBSERVER": S, "LOG": _a(S), "SCHEDULE_TYPE": S, "SCHEDULE": _a(S), "PROJECT": S, "RELEASE_DATE": D, "FLAG_ROW": B}),
    "POINTING": _struct({"ANTENNA_ID": I, "TIME": D, "INTERVAL": D, "NAME": S, "NUM_POLY": I, "TIME_ORIGIN": D, "DIRECTION": _a(D), "TARGET": _a(D), "TRACKING": B}),
    "POLARIZATION": _struct({"NUM_CORR": I, "CORR_TYPE": _a(I), "CORR_PRODUCT": _a(I), "FLAG_ROW": B}),
    "PROCESSOR": _struct({"TYPE": S, "SUB_TYPE": S, "TYPE_ID": I, "MODE_ID": I, "FLAG_ROW": B}),
    "SPECTRAL_WINDOW": _struct({"NUM_CHAN": I, "NAME": S, "REF_FREQUENCY": D, "CHAN_FREQ": _a(D), "CHAN_WIDTH": _a(D), "MEAS_FREQ_REF": I, "EFFECTIVE_BW": _a(D), "RESOLUTION": _a(D), "TOTAL_BANDWIDTH": D, "NET_SIDEBAND": I, "IF_CONV_CHAIN": I, "FREQ_GROUP": I, "FREQ_GROUP_NAME": S, "FLAG_ROW": B}),
    "STATE": _struct({"SIG": B, "REF": B, "CAL": D, "LOAD": D, "SUB_SCAN": I, "OBS_MODE": S, "FLAG_ROW": B}),
    "DOPPLER": _struct({"DOPPLER_ID": I, "SOURCE_ID": I, "TRANSITION_ID": I, "VELDEF": D}),
    "FREQ_OFFSET": _struct({"ANTENNA1": I, "ANTENNA2": I, "FEED_ID": I, "SPECTRAL_WINDOW_ID": I, "TIME": D, "INTERVAL": D, "OFFSET": D}),
    "SOURCE": _struct({"SOURCE_ID": I, "TIME": D, "INTERVAL": D, "SPECTRAL_WINDOW_ID": I, "NUM_LINES": I, "NAME": S, "CALIBRATION_GROUP": I, "CODE": S, "DIRECTION": _a(D), "PROPER_MOTION": _a(D)}),
    "SYSCAL": _struct({"ANTENNA_ID": I, "FEED_ID": I, "SPECTRAL_WINDOW_ID": I, "TIME": D, "INTERVAL": D, "TSYS": _a(F32)}),
    "WEATHER": _struct({"ANTENNA_ID": I, "TIME": D, "INTERVAL": D, "TEMPERATURE": F32, "PRESSURE": F32, "REL_HUMIDITY": F32, "WIND_SPEED": F32, "WIND_DIRECTION": F32}),
}
REQUIRED = ("ANTENNA", "DATA_DESCRIPTION", "FEED", "FIELD", "FLAG_CMD", "HISTORY", "OBSERVATION", "POINTING", "POLARIZATION", "PROCESSOR", "SPECTRAL_WINDOW", "STATE")
#: Main columns that refer to rows of a dimension table.
FOREIGN_KEYS = {"ANTENNA1": "ANTENNA", "ANTENNA2": "ANTENNA", "FIELD_ID": "FIELD", "DATA_DESC_ID": "DATA_DESCRIPTION", "OBSERVATION_ID": "OBSERVATION", "STATE_ID": "STATE"}
