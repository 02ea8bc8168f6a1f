"""tidewake: PySpark analytics for vehicle sensor logs and operations tables."""
