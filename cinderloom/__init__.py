"""cinderloom: PySpark-native analytics for teacher-student distillation experiments."""
