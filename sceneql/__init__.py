"""sceneql: time-coded, multimodal scene analytics as PySpark DataFrame operators."""
