"""Operators: functions `op(df, …) -> DataFrame`, and fit/transform pairs where state is learned."""
