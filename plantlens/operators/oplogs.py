"""Statistics over error and request logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.operators import windows

# Message shown for each error class, and the fallback.
FRIENDLY = {
    "ValidationAPIError": "输入数据有误，请检查您提供的信息是否完整、格式是否正确",
    "AuthenticationAPIError": "身份验证失败，请重新登录或检查您的凭据",
    "AuthorizationAPIError": "您没有执行此操作的权限",
    "ResourceNotFoundAPIError": "请求的资源不存在，请检查URL或参数是否正确",
    "RateLimitAPIError": "请求频率过高，请稍后再试",
    "DatabaseAPIError": "数据库操作失败，请稍后再试",
    "PredictionModelAPIError": "排放预测模型计算失败，请调整参数或稍后再试",
    "NLPModelAPIError": "自然语言处理失败，请尝试重新表述您的查询",
    "SpeechRecognitionAPIError": "语音识别失败，请确保录音清晰或使用文本输入",
}
FRIENDLY_DEFAULT = "系统发生错误，请稍后再试或联系技术支持"

LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def error_stats(log: DataFrame, *, error_type: str, ts: str, error_id: str, last: int = 100) -> DataFrame:
    """Count, first and last stamp per error type, with its most recent ``last`` stamps, newest first."""
    counts = log.groupBy(error_type).agg(F.count("*").alias("errors"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    recent = windows.top_per_group(log.select(error_type, ts, error_id), [error_type], [F.desc(ts), F.asc(error_id)], last)
    stamps = recent.groupBy(error_type).agg(F.array_sort(F.collect_list(F.struct("rank", ts))).alias("_s"))
    return counts.join(stamps, error_type, "left").select(
        error_type, "errors", "first_seen", "last_seen", F.col(f"_s.{ts}").alias("recent"))


def recent_errors(log: DataFrame, *, ts: str, error_id: str, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc(ts), error_id).limit(n)


def find_error(log: DataFrame, error_id: str, value) -> DataFrame:
    return log.filter(F.col(error_id) == value)


def request_stats(log: DataFrame, *, by: Sequence[str] = ("method", "endpoint"), latency: str = "latency", failed: Column,
                  buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Requests, errors, mean, peak and cumulative latency buckets per endpoint, one aggregation."""
    cells = [F.count_if(F.col(latency) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in buckets]
    return log.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("errors"), F.avg(latency).alias("mean_latency"),
        F.max(latency).alias("peak_latency"), F.avg(failed.cast("int")).alias("error_rate"), *cells,
    )


def friendly_message(error_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FRIENDLY.items() for x in pair])
    return F.coalesce(F.element_at(table, error_type), F.lit(FRIENDLY_DEFAULT))


def enrich(log: DataFrame, *, error_type: str, info: str) -> DataFrame:
    """Message for the user, and whether the browser or the server reported the error.

    ``info`` is the free JSON text of the record.
    """
    source = F.coalesce(F.get_json_object(info, "$.source"), F.lit("server"))
    return log.withColumns({"message": friendly_message(F.col(error_type)), "source": source})
