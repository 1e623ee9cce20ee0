"""panelflow.streaming"""
