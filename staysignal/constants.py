"""Fixed values that must equal the reference behaviour for identical results.

Everything here is data (names, lookup tables, thresholds, catalog text);
no logic lives in this module.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — column names and domains of the customer table
# ---------------------------------------------------------------------------
ID_COL = "customerID"
TARGET = "Churn"

RAW_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges", "Churn",
]

BINARY_COLS = ["Partner", "Dependents", "PhoneService", "PaperlessBilling"]
INTERNET_SERVICE_COLS = ["OnlineSecurity", "OnlineBackup", "DeviceProtection",
                         "TechSupport", "StreamingTV", "StreamingMovies"]
SERVICE_COLS = INTERNET_SERVICE_COLS + ["MultipleLines"]

# Feature lists of the cleaned table (what dtype sniffing yields on it).
NUMERIC_FEATURES = ["SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
                    "PaperlessBilling", "MonthlyCharges", "TotalCharges"]
CATEGORICAL_FEATURES = ["gender", "MultipleLines", "InternetService", "OnlineSecurity",
                        "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
                        "StreamingMovies", "Contract", "PaymentMethod"]

# Columns the upload form requires before anything runs.
UPLOAD_REQUIRED = ["tenure", "MonthlyCharges", "Contract", "InternetService",
                   "PaymentMethod", "TotalCharges"]

# Yes/No spellings read by cleaning; "1" and "0" only with strict=False.
YES_NO_MAP = {"Yes": 1, "No": 0, "True": 1, "False": 0, "1": 1, "0": 0}
NO_INTERNET = "No internet service"
NO_PHONE = "No phone service"

# ---------------------------------------------------------------------------
# FIXED VALUES — tenure bands (right-closed bins)
# ---------------------------------------------------------------------------
EDA_BAND_EDGES = [0, 12, 24, 36, 48, 60, 72, 100]
EDA_BAND_LABELS = ["0-12", "13-24", "25-36", "37-48", "49-60", "61-72", "73+"]
COHORT_BAND_EDGES = [0, 12, 24, 36, 48, 60, 72]
COHORT_BAND_LABELS = ["0–12", "12–24", "24–36", "36–48", "48–60", "60–72"]
NOTEBOOK_BAND_EDGES = [0, 12, 24, 36, 48, 60, 72]
NOTEBOOK_BAND_LABELS = ["0-1 Year", "1-2 Years", "2-3 Years", "3-4 Years", "4-5 Years", "5+ Years"]

# ---------------------------------------------------------------------------
# FIXED VALUES — lifetime value and ROI
# ---------------------------------------------------------------------------
EXPECTED_TOTAL_MONTHS = {"Month-to-month": 24, "One year": 36, "Two year": 60}
DEFAULT_EXPECTED_MONTHS = 24
DEFAULT_MONTHLY_CHARGE = 65.0
DEFAULT_TENURE = 12.0
DEFAULT_PROBABILITY_PCT = 50.0
BREAKEVEN_MAX_MONTHS = 48

# ---------------------------------------------------------------------------
# FIXED VALUES — risk levels and decision threshold
# ---------------------------------------------------------------------------
RISK_LOW_MAX = 0.3
RISK_MEDIUM_MAX = 0.6
DECISION_THRESHOLD = 0.5
WHAT_IF_DEAD_BAND = 0.01

# ---------------------------------------------------------------------------
# FIXED VALUES — clustering ordinal maps and feature list
# ---------------------------------------------------------------------------
CLUSTER_NUM_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"]
CLUSTER_CAT_MAP = {
    "Contract": {"Month-to-month": 0, "One year": 1, "Two year": 2},
    "InternetService": {"No": 0, "DSL": 1, "Fiber optic": 2},
    "PaymentMethod": {"Mailed check": 0, "Bank transfer (automatic)": 1,
                      "Credit card (automatic)": 1, "Electronic check": 2},
}

# ---------------------------------------------------------------------------
# FIXED VALUES — retention action catalog (id, title, effort, category)
# Eligibility predicates and overrides live in functions/actions.py.
# ---------------------------------------------------------------------------
ACTIONS = [
    ("upgrade_2yr", "Upgrade to 2-Year Contract", "Medium", "Contract"),
    ("upgrade_1yr", "Upgrade to 1-Year Contract", "Low", "Contract"),
    ("add_tech_support", "Add Tech Support", "Low", "Services"),
    ("add_online_security", "Add Online Security", "Low", "Services"),
    ("add_online_backup", "Add Online Backup", "Low", "Services"),
    ("device_protection", "Add Device Protection", "Low", "Services"),
    ("switch_auto_payment", "Switch to Automatic Payment", "Low", "Billing"),
    ("loyalty_discount", "Offer 15% Loyalty Discount", "Medium", "Pricing"),
]
LOYALTY_DISCOUNT_FACTOR = 0.85
LOYALTY_DISCOUNT_FLOOR = 25.0
LOYALTY_CHARGE_MIN = 70.0
ACTION_COST_PRICING = 50.0
ACTION_COST_OTHER = 20.0
TOP_ACTIONS = 6

# ---------------------------------------------------------------------------
# FIXED VALUES — what-if scenario defaults (attribute -> value tried)
# ---------------------------------------------------------------------------
WHAT_IF_SCENARIO = {
    "Contract": "Two year",
    "tenure": 24,
    "MonthlyCharges": 55.0,
    "InternetService": "DSL",
    "TechSupport": "Yes",
    "OnlineSecurity": "Yes",
    "PaymentMethod": "Bank transfer (automatic)",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — evaluation grids
# ---------------------------------------------------------------------------
THRESHOLD_GRID_LOW = 0.05
THRESHOLD_GRID_HIGH = 0.95
THRESHOLD_GRID_POINTS = 50
CALIBRATION_BINS = 10
PDP_GRID_POINTS = 50
SHAP_TOP = 10
SHAP_BINS = 20
WATERFALL_TOP = 8  # attributions shown one by one; the rest is one row
TOP_RISK_N = 10
TOP_CLV_N = 5
RECENT_N = 20
HEAD_N = 5
HIST_BINS = 30
