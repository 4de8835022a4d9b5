"""Operators: functions from DataFrame to DataFrame, shared by batch and streaming where stateless."""
