"""Fixed values.

FIXED VALUES - these must equal the reference application's values for the
results to match (column names, category domains, bucket edges, thresholds,
texts). They are stated plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
TARGET = "Churn"
ID_COL = "customerID"

# tenure buckets: edges and labels, intervals closed on the right
TENURE_EDGES = [0, 6, 12, 24, 72]
TENURE_LABELS = ["0-6m", "6-12m", "12-24m", "24m+"]

# service columns counted by services_count
SERVICE_COLUMNS = [
    "PhoneService", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
]

# expected tenure (months) used for customer lifetime value
EXPECTED_TENURE = 36

# fallback median of MonthlyCharges used by the manual-entry form
FORM_FALLBACK_MEDIAN = 70.0

# CLV segments in ascending order
CLV_SEGMENTS = ["Low", "Medium", "High", "Premium"]

# decision threshold and display tiers
DECISION_THRESHOLD = 0.5
CONFIDENCE_HIGH_ABOVE = 0.75
CONFIDENCE_HIGH_BELOW = 0.25
GAUGE_BANDS = [0, 33, 66, 100]
GAUGE_ALERT_LINE = 70
VALUE_PRIORITY_HIGH = 2500
VALUE_PRIORITY_MEDIUM = 1500
ACTION_URGENT_ABOVE = 0.7
ACTION_MODERATE_ABOVE = 0.4

# validation targets (warning below)
TARGET_VAL_AUC = 0.8
TARGET_VAL_RECALL = 0.6

# recommended actions per tier, in display order
ACTIONS = {
    "URGENT": [
        "Immediate personal outreach by retention specialist",
        "Offer premium retention package or loyalty discount",
        "Conduct satisfaction survey to identify pain points",
        "Review account for service issues or billing problems",
        "Consider contract upgrade incentives",
    ],
    "MODERATE": [
        "Schedule proactive check-in call",
        "Send satisfaction survey",
        "Offer loyalty program enrollment",
        "Review service usage patterns",
        "Provide educational materials on service benefits",
    ],
    "LOW": [
        "Standard engagement protocols",
        "Consider upselling opportunities",
        "Maintain service quality",
        "Send periodic satisfaction checks",
        "Reward loyalty with small perks",
    ],
}
ACTION_HEADLINES = {
    "URGENT": "URGENT: High Churn Risk",
    "MODERATE": "MODERATE: Monitor Closely",
    "LOW": "LOW RISK: Stable Customer",
}

# rule-based risk factors, in display order
RISK_FACTOR_TEXTS = [
    "Month-to-month contract increases churn risk",
    "Fiber optic without tech support may lead to dissatisfaction",
    "Electronic check payment has higher failure rates",
    "New customers (< 6 months) have elevated churn risk",
    "High monthly charges may indicate price sensitivity",
    "Lack of security services suggests low engagement",
]
RISK_FACTOR_DEFAULT = "Customer profile suggests stable engagement"
RISK_NEW_CUSTOMER_MONTHS = 6
RISK_HIGH_CHARGES = 80

# input domains of the manual-entry form
CATEGORY_DOMAINS = {
    "gender": ["Female", "Male"],
    "Partner": ["Yes", "No"],
    "Dependents": ["Yes", "No"],
    "PhoneService": ["Yes", "No"],
    "MultipleLines": ["Yes", "No", "No phone service"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "OnlineSecurity": ["Yes", "No", "No internet service"],
    "OnlineBackup": ["Yes", "No", "No internet service"],
    "DeviceProtection": ["Yes", "No", "No internet service"],
    "TechSupport": ["Yes", "No", "No internet service"],
    "StreamingTV": ["Yes", "No", "No internet service"],
    "StreamingMovies": ["Yes", "No", "No internet service"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaperlessBilling": ["Yes", "No"],
    "PaymentMethod": ["Electronic check", "Mailed check",
                      "Bank transfer (automatic)", "Credit card (automatic)"],
}
NUMERIC_DOMAINS = {
    "SeniorCitizen": (0, 1),
    "tenure": (0, 100),
    "MonthlyCharges": (0.0, 200.0),
}

# defaults the manual-entry form fills in for fields it does not ask for
FORM_DEFAULTS = {
    "gender": "Male",
    "Dependents": "No",
    "DeviceProtection": "No",
    "StreamingTV": "No",
    "StreamingMovies": "No",
    "PaperlessBilling": "Yes",
}
# ------------------------------------------------------------ end fixed values

# Raw customer table: 21 columns, in file order.
RAW_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges", "Churn",
]

# String columns of the raw table that are label-encoded (plus tenure_bucket).
RAW_CATEGORICAL = [
    "gender", "Partner", "Dependents", "PhoneService", "MultipleLines",
    "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
    "PaperlessBilling", "PaymentMethod",
]
CATEGORICAL = RAW_CATEGORICAL + ["tenure_bucket"]

ENGINEERED = [
    "tenure_bucket", "services_count", "monthly_to_total_ratio",
    "internet_no_tech_support", "phone_no_security", "premium_no_backup",
    "long_tenure_low_value", "expected_tenure", "clv",
]
FLAG_COLUMNS = [
    "internet_no_tech_support", "phone_no_security",
    "premium_no_backup", "long_tenure_low_value",
]

# Model feature order: raw columns without id and target, then engineered ones.
FEATURES = [c for c in RAW_COLUMNS if c not in (ID_COL, TARGET)] + ENGINEERED
NUMERIC_FEATURES = [c for c in FEATURES if c not in CATEGORICAL]

MODEL_NAMES = ["logistic_regression", "random_forest", "xgboost"]
