"""Operators: functions from DataFrame to DataFrame. All are lazy."""
