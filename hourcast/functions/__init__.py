"""Column functions: time zones, calendar, weather physics, text."""
from .calendar import cyclic, is_us_holiday
from .text import name_family, name_lag, truthy
from .timezones import day_hours, local_of, local_status, utc_of
from .weather import cooling, heat_index, heating, wet_bulb
