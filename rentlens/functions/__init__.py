"""Column functions: built-in expressions only, no Python workers."""

from .dates import instant_micros, moment, target_arrival, whole_days_between
from .geo import crosses, haversine_miles, planar_distance, signed_turns
from .links import listing_link, route_link
from .money import floor_area_sqft, floor_area_sqm, monthly_rent
from .postcodes import postcode_parts, postcode_problem

__all__ = [
    "crosses", "floor_area_sqft", "floor_area_sqm", "haversine_miles", "instant_micros",
    "listing_link", "moment", "monthly_rent", "planar_distance", "postcode_parts", "postcode_problem",
    "route_link", "signed_turns", "target_arrival", "whole_days_between",
]
