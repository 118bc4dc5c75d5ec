from .adapters import readings_from_events, survey_from_orders, predictions_from_readings  # noqa: F401
from .io import read_readings, read_survey, save_table, load_table, save_model, load_model  # noqa: F401
