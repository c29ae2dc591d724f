"""What functions that are never executed show: fixed values, name by name."""

from __future__ import annotations

LITERALS = {
    "WEBSERVICE": "#VALUE!",
    "RTD": "#N/A",
    "STOCKHISTORY": "#CONNECT!",
    "DETECTLANGUAGE": "#CONNECT!",
    "TRANSLATE": "#CONNECT!",
    "COPILOT": "#CONNECT!",
    "IMAGE": "#CONNECT!",
    "CALL": "#BLOCKED!",
    "REGISTER.ID": "#BLOCKED!",
    "CUBEVALUE": "#NAME?",
    "CUBEMEMBER": "#NAME?",
    "CUBESET": "#NAME?",
    "CUBESETCOUNT": "#NAME?",
    "CUBERANKEDMEMBER": "#NAME?",
    "CUBEKPIMEMBER": "#NAME?",
    "CUBEMEMBERPROPERTY": "#NAME?",
    "GETPIVOTDATA": "#REF!",
}
