"""The 19 signal metrics.  Each is ``fn(sig, f=None, **params) -> DataFrame``, lazy."""

from feedlens.operators.metrics.direction import (  # noqa: F401
    churn_causes, company_product_heatmap, competitive_benchmark, prechurn_trend,
    regulatory_exposure,
)
from feedlens.operators.metrics.marketing import (  # noqa: F401
    complaint_velocity, monthly_activity, nps_breakdown, nps_proxy, sentiment_by_channel,
    source_impact,
)
from feedlens.operators.metrics.product import (  # noqa: F401
    app_issue_topics, device_comparison, rating_distribution, yoy_volume_sentiment,
)
from feedlens.operators.metrics.retention import (  # noqa: F401
    behavior_cycle, complaint_topics, escalation_rate, product_risk, state_intensity,
)
