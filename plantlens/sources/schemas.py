"""Explicit schemas of the files and of the relational star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampNTZType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


EMISSION_METRICS = ("SO2", "NOx", "CO2", "DUST", "O2", "TEMPERATURE", "FLOW", "PH")

AREA = _struct(AREA_CODE=_S, AREA_NAME=_S, PARENT_CODE=_S)
FACTORY = _struct(
    FAC_ID=_S, AREA_CODE=_S, FAC_NAME=_S, GROUP_ID=_S, FAC_ADDR=_S, X_MAP=_D, Y_MAP=_D, FAC_ALIAS=_S, ACTIVE_FLAG=_L
)
STEAMER = _struct(STEAMER_ID=_S, STEAMER_NAME=_S, FAC_ID=_S, RATING_FH=_D, ACTIVE_FLAG=_L, STEAMER_TYPE=_S)
CHANNEL = _struct(FAC_ID=_S, CHANNEL_NUM=_L, CHANNEL_NAME=_S, KKS_WORK=_S, ACTIVE_FLAG=_L)
HISTORY = _struct(KKS_WORK=_S, RECTIME=_TS, VALUE=_D)
_TAIL = dict(FD_KWH=_D, CHK_TIME=_D, STOP_TIME=_D, STOP_CAUSE=_S, OVER_MULTIPLE=_D, TIME_2TO30=_L, TIME_30TO50=_L)
FACT_SO2 = _struct(RECTIME=_TS, STEAMER_ID=_S, VENT_SO2_CHK=_D, VENT_SO2_T=_D, FGD_EFCY=_D, **_TAIL)
FACT_NOX = _struct(RECTIME=_TS, STEAMER_ID=_S, VENT_NOX_CHK=_D, VENT_NOX_T=_D, SCR_EFCY=_D, **_TAIL)
FACT_SOOT = _struct(RECTIME=_TS, STEAMER_ID=_S, VENT_SOOT_CHK=_D, VENT_SOOT_T=_D, **_TAIL)

# table -> (schema, primary key, foreign keys as column -> (table, column))
TABLES = {
    "TS_AREA": (AREA, ("AREA_CODE",), {}),
    "TB_FACTORY": (FACTORY, ("FAC_ID",), {"AREA_CODE": ("TS_AREA", "AREA_CODE")}),
    "TB_STEAMER": (STEAMER, ("STEAMER_ID",), {"FAC_ID": ("TB_FACTORY", "FAC_ID")}),
    "tb_rtu_channel": (CHANNEL, ("CHANNEL_NUM",), {"FAC_ID": ("TB_FACTORY", "FAC_ID")}),
    "td_hisdata": (HISTORY, ("KKS_WORK", "RECTIME"), {}),
    "td_dtl_2025": (FACT_SO2, ("STEAMER_ID", "RECTIME"), {"STEAMER_ID": ("TB_STEAMER", "STEAMER_ID")}),
    "td_dtx_2025": (FACT_NOX, ("STEAMER_ID", "RECTIME"), {"STEAMER_ID": ("TB_STEAMER", "STEAMER_ID")}),
    "td_dcc_2025": (FACT_SOOT, ("STEAMER_ID", "RECTIME"), {"STEAMER_ID": ("TB_STEAMER", "STEAMER_ID")}),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a fixed schema by name; absent columns become typed nulls, extras are dropped."""
    from pyspark.sql import functions as F

    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Register frames as views under their fixed schemas; returns the view names."""
    for name, df in tables.items():
        conform(df, TABLES[name][0]).createOrReplaceTempView(name)
    return list(tables)
